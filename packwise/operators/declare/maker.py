"""Manufacturer or packer name and address."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import has_any, strip

AHEAD = 4
LOOKS_AT = ["stripped", "maker_stop", "pin"]
PASS = 1 << 40
AFTER_KEYWORD = "(?s)" + V.MAKER_KEYWORD + "(.*)$"


def features() -> dict[str, Column]:
    text = strip(F.col("text"))
    digits = F.col("digits")
    stop = has_any(F.col("upper"), V.MAKER_STOP_WORDS)
    for pattern in (V.MRP_KEYWORD, V.CARE_KEYWORD, V.ORIGIN):
        stop = stop | text.rlike(pattern)
    stop = stop | (digits & (text.rlike(V.NET_QTY) | text.rlike(V.PHONE)))
    stop = stop | (text.contains("@") & text.rlike(V.EMAIL))
    return {"stripped": text, "maker_stop": stop, "pin": digits & text.rlike(V.PIN_6)}


def _address(first: Column) -> Column:
    """`first` and the following lines up to a stop line or including the first line with a pin code."""
    going, parts = F.lit(True), [F.nullif(first, F.lit(""))]
    for k in (1, 2, 3, 4):
        n = F.col(f"next{k}")
        going = going & n.isNotNull() & ~n["maker_stop"]
        parts.append(F.when(going, F.nullif(n["stripped"], F.lit(""))))
        going = going & ~n["pin"]
    return strip(F.concat_ws(", ", *parts), " ,.-")


def steps() -> list[tuple[str, Column]]:
    text = F.col("text")
    # an empty remainder still counts as a maker line
    rest = F.when(text.rlike(V.MAKER_KEYWORD), strip(F.regexp_extract(text, AFTER_KEYWORD, 1), " :.-"))
    named = text.rlike(V.MAKER_CORPORATE) & ~has_any(F.col("upper"), V.MAKER_CONTEXT_SKIP)
    return [
        ("maker_rest", rest),
        ("maker_corporate", F.when(named, strip(text, " :.-"))),
        # a line that already ends the address with a pin code stands alone
        ("maker_one", F.when(F.col("maker_rest").rlike(V.PIN_6), strip(F.col("maker_rest"), " ,.-"))),
        ("maker_block", F.when(F.col("maker_rest").isNotNull(), _address(F.col("maker_rest")))),
        ("maker_corporate_one", F.when(F.col("pin"), F.col("maker_corporate"))),
        ("maker_corporate_block", F.when(F.col("maker_corporate").isNotNull(), _address(F.col("maker_corporate")))),
        ("maker_first", F.coalesce("maker_one", _long_enough(F.col("maker_block"), V.MIN_MAKER_LENGTH))),
        (
            "maker_second",
            F.coalesce("maker_corporate_one", _long_enough(F.col("maker_corporate_block"), V.MIN_CORPORATE_LENGTH)),
        ),
    ]


def _long_enough(value: Column, least: int) -> Column:
    return F.when(F.length(value) >= least, value)


def candidates() -> list[tuple[str, Column, Column]]:
    first = F.col("maker_first")
    rank = F.col("line_no") + F.when(first.isNull(), F.lit(PASS)).otherwise(F.lit(0))
    return [("", rank.cast("long"), F.coalesce(first, "maker_second"))]
