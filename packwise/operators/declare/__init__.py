"""Declaration extraction: label lines in, one row of declared fields per panel out.

Each field module offers `features()`, columns of one line alone, and
`candidate()`, a (rank, value) pair for the line that may look at the features of
the following lines.  The winner of a panel is the candidate with the lowest
rank, taken by a partial aggregate, so no panel is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.fuzzy import repair_numeric
from ...functions.text import SPACES, strip
from ..ordering import with_lookahead
from . import contact, generic, maker, origin, price, produced, quantity, unit_price

FIELD_MODULES = {
    "mrp": price,
    "net_quantity": quantity,
    "manufacture_date": produced,
    "country_of_origin": origin,
    "manufacturer": maker,
    "consumer_care": contact,
    "generic_name": generic,
    "unit_sale_price": unit_price,
}
KEYS = ["insp_no", "panel_no"]


def sanitize(text: Column) -> Column:
    """Repair full-width marks, dashes and spaced-out acronyms of a line."""
    plain = F.translate(text, V.SANITIZE_CHARS_FROM, V.SANITIZE_CHARS_TO)
    dotted = dotless = plain
    for pattern, replacement in V.SANITIZE_STEPS:
        dotted = F.regexp_replace(dotted, pattern, replacement)
        if r"\." not in pattern:
            dotless = F.regexp_replace(dotless, pattern, replacement)
    # a pattern with a dot in it cannot match a line without one
    return F.when(text.contains("."), dotted).otherwise(dotless)


def _with_line_columns(lines: DataFrame) -> DataFrame:
    """Columns many patterns share, computed once per line."""
    return lines.select(
        "*",
        F.upper("text").alias("upper"),
        F.lower("text").alias("lower"),
        F.col("text").rlike("[0-9]").alias("digits"),
    )


def line_candidates(lines: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per line, one `c_<field>` struct<rank, value> for each field (null when the line has none)."""
    keys = keys or KEYS
    modules = [FIELD_MODULES[f] for f in fields]
    clean = lines.select(*keys, "line_no", sanitize(F.col("text")).alias("text"))

    needed: dict[str, Column] = {}
    for m in modules:
        needed.update(m.features())
    ahead = max(m.AHEAD for m in modules)
    if ahead:
        seen = sorted({name for m in modules for name in m.LOOKS_AT})
        payload = F.struct(*[needed[name].alias(name) for name in seen])
        clean = with_lookahead(clean, keys, "line_no", payload, ahead, _with_line_columns)
        own = {name: (F.col("__payload")[name] if name in seen else col) for name, col in needed.items()}
    else:
        clean, own = _with_line_columns(clean), needed
    df = clean.select(
        *keys, "line_no", "text", "upper", "lower", "digits", *[f"next{k}" for k in range(1, ahead + 1)],
        *[col.alias(name) for name, col in own.items()],
    )
    for m in modules:
        for name, col in m.steps():
            df = df.withColumn(name, col)
    names, values = [], []
    for f, m in zip(fields, modules):
        for suffix, rank, value in m.candidates():
            names.append(f + suffix)
            values += [rank.alias(f"r_{f}{suffix}"), value.alias(f"v_{f}{suffix}")]
    # values become columns first, so that testing them for null does not compute them twice
    return df.select(*keys, "line_no", *values).select(
        *keys,
        "line_no",
        *[
            F.when(F.col(f"v_{n}").isNotNull(), F.struct(F.col(f"r_{n}").alias("rank"), F.col(f"v_{n}").alias("value")))
            .alias(f"c_{n}")
            for n in names
        ],
    )


def pick_winners(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The best candidate of each field per panel."""
    keys = keys or KEYS
    cols = [c for c in candidates.columns if c.startswith("c_")]
    best = candidates.groupBy(*keys).agg(*[F.min(c)["value"].alias(c[2:]) for c in cols])
    if "consumer_care" in best.columns:
        best = best.withColumn(
            "consumer_care",
            F.coalesce(
                F.col("consumer_care"),
                contact.fallback(
                    F.col("consumer_care_phone"), F.col("consumer_care_email"), F.col("consumer_care_site")
                ),
            ),
        ).drop("consumer_care_phone", "consumer_care_email", "consumer_care_site")
    return best


def extract_fields(
    lines: DataFrame, fields: list[str] | None = None, keys: list[str] | None = None, repair: bool = False
) -> DataFrame:
    """Declared fields per panel from lines (keys, line_no numbered from 1, text).

    With `repair` the three numeric fields also get their look-alike letters undone.
    """
    fields = fields or V.EXTRACTED_FIELDS
    out = pick_winners(line_candidates(lines, fields, keys), keys)
    if repair:
        for f in ("mrp", "net_quantity", "manufacture_date"):
            if f in fields:
                out = out.withColumn(f, repair_numeric(F.col(f)))
    return out


def lines_of_text(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Numbered non-blank lines of a raw text column (the whole text)."""
    raw = F.split(F.col(text), V.LINE_BREAKS)
    kept = F.filter(F.transform(raw, lambda t: strip(t, SPACES)), lambda t: t != "")
    return docs.select(*keys, F.posexplode(kept).alias("pos", "text")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "text"
    )
