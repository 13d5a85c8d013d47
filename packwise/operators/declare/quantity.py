"""Net quantity."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import has_any, match
from ...functions.units import standard_unit

AHEAD = 1
LOOKS_AT = ["alone_value", "alone_unit"]
PASS = 1 << 40  # rank = pass * PASS + line number


def features() -> dict[str, Column]:
    text = F.col("text")
    return {
        "alone_value": F.when(F.col("digits"), match(text, V.STANDALONE_QTY, 1)),
        "alone_unit": F.when(F.col("digits"), match(text, V.STANDALONE_QTY, 2)),
    }


def steps() -> list[tuple[str, Column]]:
    text = F.col("text")
    return [
        ("net_value", F.when(F.col("digits"), match(text, V.NET_QTY, 1))),
        ("net_unit", F.when(F.col("net_value").isNotNull(), match(text, V.NET_QTY, 2))),
        (
            "net_next",
            F.col("next1")["alone_value"].isNotNull() & has_any(F.col("upper"), V.NET_QTY_WORDS),
        ),
        (
            "net_alone",
            F.col("alone_value").isNotNull()
            & ~has_any(F.col("lower"), V.NUTRITION_WORDS)
            & F.col("alone_value").rlike(r"^\d+(\.0*)?$"),
        ),
    ]


def candidates() -> list[tuple[str, Column, Column]]:
    first, second, third = F.col("net_value").isNotNull(), F.col("net_next"), F.col("net_alone")
    n = F.col("next1")
    number = F.when(first, F.col("net_value")).when(second, n["alone_value"]).when(third, F.col("alone_value"))
    unit = F.when(first, F.col("net_unit")).when(second, n["alone_unit"]).when(third, F.col("alone_unit"))
    rank = F.col("line_no") + F.when(first, F.lit(0)).when(second, F.lit(PASS)).otherwise(F.lit(2 * PASS))
    return [("", rank.cast("long"), F.concat(number, F.lit(" "), standard_unit(unit)))]
