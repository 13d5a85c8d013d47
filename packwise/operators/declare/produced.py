"""Month and year of manufacture or packing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import has_any, match

AHEAD = 1
LOOKS_AT = ["date_only"]
PASS = 1 << 40


def features() -> dict[str, Column]:
    return {"date_only": F.when(F.col("digits"), match(F.col("text"), V.DATE_ONLY, 1))}


def steps() -> list[tuple[str, Column]]:
    text = F.col("text")
    return [
        # the shortest date the pattern allows, such as 1-99, has four characters
        ("date_found", F.when(F.col("digits"), match(text, V.MFG_DATE, 1))),
        ("date_next", F.when(has_any(F.col("upper"), V.DATE_NEXT_LINE_WORDS), F.col("next1")["date_only"])),
        ("date_same", F.when(has_any(F.col("upper"), V.DATE_FALLBACK_WORDS), F.col("date_only"))),
    ]


def candidates() -> list[tuple[str, Column, Column]]:
    first = F.coalesce("date_found", "date_next")
    rank = F.col("line_no") + F.when(first.isNull(), F.lit(PASS)).otherwise(F.lit(0))
    return [("", rank.cast("long"), F.coalesce(first, "date_same"))]
