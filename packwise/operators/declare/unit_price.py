"""Unit sale price."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import match
from ...functions.units import standard_unit

AHEAD = 0
LOOKS_AT: list[str] = []


def features() -> dict[str, Column]:
    return {"unit_price": F.when(F.col("digits"), match(F.col("text"), V.UNIT_SALE_PRICE, 1))}


def steps() -> list[tuple[str, Column]]:
    return []


def candidates() -> list[tuple[str, Column, Column]]:
    text, price = F.col("text"), F.col("unit_price")
    currency = F.when(text.contains("₹"), F.lit("₹ ")).otherwise("Rs. ")
    unit = standard_unit(match(text, V.UNIT_SALE_PRICE, 2))
    value = F.when(price.isNotNull(), F.concat(currency, price, F.lit(" / "), unit))
    return [("", F.col("line_no").cast("long"), value)]
