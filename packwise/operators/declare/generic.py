"""Common or generic name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import has_any, match, strip, title_case, words_of

AHEAD = 0
LOOKS_AT: list[str] = []
PASS = 1 << 40


def _commodity_pattern(name: str) -> str:
    return r"\b" + r"\s*".join(name.split()) + r"\b"


def longest_commodity(text: Column) -> Column:
    """The longest listed commodity on the line (ties: list order), spaces between its words optional."""
    ordered = sorted(V.COMMODITIES, key=len, reverse=True)
    any_of = r"\b(?:" + "|".join(r"\s*".join(c.split()) for c in ordered) + r")\b"
    chain = reduce(
        lambda acc, c: acc.when(text.rlike(_commodity_pattern(c)), F.lit(c)),
        ordered[1:],
        F.when(text.rlike(_commodity_pattern(ordered[0])), F.lit(ordered[0])),
    )
    return F.when(text.rlike(any_of), chain)


def features() -> dict[str, Column]:
    text = F.col("text")
    return {
        "generic_found": strip(match(text, V.GENERIC_KEYWORD, 1), " :.-,"),
        "generic_listed": F.when(
            ~has_any(F.col("upper"), V.COMMODITY_LINE_SKIP), longest_commodity(F.col("lower"))
        ),
        "generic_title_line": F.when(
            (F.col("line_no") <= 3) & has_any(F.col("upper"), V.TITLE_CONTEXT_WORDS),
            strip(F.regexp_replace(strip(text), r"[^A-Za-z\s]", "")),
        ),
    }


def steps() -> list[tuple[str, Column]]:
    found, clean = F.col("generic_found"), F.col("generic_title_line")
    upper_words = F.regexp_extract_all(F.col("upper"), F.lit("([A-Z]+)"), F.lit(1))
    title = (
        clean.isNotNull()
        & F.length(clean).between(4, 40)
        # no word without a vowel
        & ~F.concat(F.lit(" "), F.lower(clean), F.lit(" ")).rlike(r"\s[^aeiouy\s]+\s")
        & F.size(words_of(clean)).between(1, 4)
        & ~F.arrays_overlap(upper_words, F.array(*[F.lit(w) for w in V.TITLE_EXCLUDED_WORDS]))
    )
    short = F.when(
        F.size(words_of(found)) > 8, F.array_join(F.slice(words_of(found), 1, 8), " ")
    ).otherwise(found)
    return [
        ("generic_named", F.when(F.length(found) >= 3, short)),
        ("generic_title", F.when(title, clean)),
        ("generic_chosen", F.coalesce("generic_named", "generic_listed", "generic_title")),
    ]


def candidates() -> list[tuple[str, Column, Column]]:
    named, listed, chosen = F.col("generic_named"), F.col("generic_listed"), F.col("generic_chosen")
    rank = F.col("line_no") + F.when(named.isNotNull(), F.lit(0)).when(listed.isNotNull(), F.lit(PASS)).otherwise(
        F.lit(2 * PASS)
    )
    return [("", rank.cast("long"), F.when(chosen.isNotNull(), title_case(chosen)))]
