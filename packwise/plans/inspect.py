"""From recognized tokens to evaluated inspection records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import compliance, lines as line_ops, panels as panel_ops, rules, tokens as token_ops, visual
from ..operators.declare import extract_fields
from ..session import staged

KEYS = ["insp_no", "panel_no"]
CRITICAL = list(V.RETRY_ZONES)


def inspection_id(number: Column, day: Column) -> Column:
    """`INS-yyyymmdd-6HEX`, the same on every rerun."""
    tail = F.upper(F.substring(F.sha2(number.cast("string"), 256), 1, 6))
    return F.concat(F.lit("INS-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), tail)


def recover(panels: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """First-pass tokens, merged with the second pass on the panels that need it."""
    flagged = token_ops.needs_recovery(panels, first).where("needs_recovery").select(*KEYS)
    again = second.join(flagged, KEYS, "left_semi")
    merged = token_ops.merge_passes(first, again)
    # one sequence number in the order of the merged set: kept places first, then added tokens
    place = F.col("source").cast("long") * F.lit(1 << 32) + F.col("seq")
    return merged.withColumn("seq", place).drop("source")


def missing_critical() -> Column:
    """Names of the critical fields a panel still lacks."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f)) for f in CRITICAL])
    )


def retry_in_zones(fields: DataFrame, retry_tokens: DataFrame, panels: DataFrame) -> DataFrame:
    """Fill missing price, quantity and date from tokens in the image zone where each is usually printed.

    A token is copied once per zone it lies in, so all three fields are retried in one run.
    """
    wanted = fields.select(*KEYS, F.explode(missing_critical()).alias("field"))
    zones = F.array_compact(
        F.array(
            *[
                F.when(token_ops.in_zone(f, F.col("image_width"), F.col("image_height")), F.lit(f))
                for f in CRITICAL
            ]
        )
    )
    zoned = (
        retry_tokens.join(panels.select(*KEYS, "image_width", "image_height"), KEYS)
        .select(*retry_tokens.columns, F.explode(zones).alias("field"))
        .join(wanted, [*KEYS, "field"], "left_semi")
    )
    keys = [*KEYS, "field"]
    found = extract_fields(line_ops.normalize(zoned, keys), CRITICAL, keys, repair=True)
    per_panel = found.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("field") == f, F.col(f))).alias(f"retry_{f}") for f in CRITICAL]
    )
    filled = fields.join(per_panel, KEYS, "left")
    for f in CRITICAL:
        filled = filled.withColumn(f, F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"retry_{f}")))
    return filled.drop(*[f"retry_{f}" for f in CRITICAL])


def panel_fields(lines: DataFrame) -> DataFrame:
    """Repaired declarations per panel with the derived unit price."""
    return panel_ops.fill_unit_price(extract_fields(lines, repair=True))


def token_means(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return tokens.groupBy(*keys).agg(
        compliance.mean_positive(F.col("confidence")).alias("token_confidence"),
        F.count(F.lit(1)).alias("token_count"),
    )


def judge(records: DataFrame) -> DataFrame:
    """Rules and compliance for records that carry fields, visuals, category and token_confidence."""
    return compliance.with_compliance(rules.evaluate(records), "token_confidence")


def panel_declarations(panels: DataFrame, tokens: DataFrame, retry_tokens: DataFrame | None = None) -> DataFrame:
    """Declarations of every panel from its tokens: lines, fields, and a second try in zones for missing ones."""
    fields = extract_fields(line_ops.normalize(tokens), repair=True)
    fields = panels.select(*KEYS).join(fields, KEYS, "left")
    return fields if retry_tokens is None else retry_in_zones(staged(fields), retry_tokens, panels)


def inspect_panels(
    panels: DataFrame, tokens: DataFrame, visuals: DataFrame, retry_tokens: DataFrame | None = None
) -> DataFrame:
    """Every panel as an inspection of its own.

    Merged tokens and first-round fields are read several times, so they are staged.
    """
    tokens = staged(tokens)
    fields = panel_declarations(panels, tokens, retry_tokens)
    base = panel_ops.fill_unit_price(panels.join(fields, KEYS, "left"))
    records = base.join(visuals, KEYS, "left").join(token_means(tokens, KEYS), KEYS, "left")
    return judge(panel_ops.with_all_fields(records))


def inspect_packages(
    inspections: DataFrame, panel_declarations: DataFrame, tokens: DataFrame | None, visuals: DataFrame
) -> DataFrame:
    """All panels of a package merged into one inspection.

    `inspections` has insp_no and category; inspections without any panel stay in with
    nothing declared.  `panel_declarations` already carries panel-level unit prices.
    """
    key = ["insp_no"]
    merged = panel_ops.fill_unit_price(panel_ops.merge_fields(panel_declarations, key))
    seen = panel_ops.merge_visuals(visuals, key).drop("panel_count")
    records = inspections.join(merged, key, "left").join(seen, key, "left")
    if tokens is None:
        records = records.withColumn("token_confidence", F.lit(None).cast("double"))
    else:
        records = records.join(token_means(tokens, key).drop("token_count"), key, "left")
    return judge(panel_ops.with_all_fields(records))


OVERRIDABLE = V.TEXT_FIELDS + V.FLAG_FIELDS + ["product_name", "category"]


def apply_overrides(records: DataFrame, overrides: DataFrame, key: str = "insp_no") -> DataFrame:
    """An inspector's corrections over stored records, judged again.

    A null correction keeps the stored value; an empty text replaces it.  Columns of
    the record that no correction touches, such as the image lists, are kept.
    """
    touched = [c for c in overrides.columns if c in OVERRIDABLE]
    renamed = overrides.select(key, *[F.col(c).alias(f"new_{c}") for c in touched])
    stale = ["rule_results", "status", "score", "violations", "confidence"]
    merged = records.drop(*stale).join(renamed, key, "inner")
    for c in touched:
        merged = merged.withColumn(c, F.coalesce(F.col(f"new_{c}"), F.col(c)))
    return judge(merged.drop(*[f"new_{c}" for c in touched]))


def visual_records(panels: DataFrame, metrics: DataFrame, regions: DataFrame) -> DataFrame:
    """Visual checks of every panel from quality metrics and detected boxes."""
    sized = regions.join(metrics.select(*KEYS, "image_width", "image_height"), KEYS)
    kept = visual.keep_label_regions(sized, F.col("image_width"), F.col("image_height"))
    return visual.visual_checks(panels.select(*KEYS), metrics, visual.median_heights(kept, KEYS), KEYS)
