"""Unit names and unit prices."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import fixed, half_up_fixed2, let, match, rounded, strip


def standard_unit(unit: Column) -> Column:
    """Canonical unit name; an unknown unit is returned as it came."""
    key = F.regexp_replace(strip(F.lower(unit)), r"\s+", " ")
    aliases = F.create_map(*[F.lit(v) for v in chain.from_iterable(V.UNIT_ALIASES.items())])
    return F.coalesce(F.try_element_at(aliases, key), unit)


def price_number(price: Column, pattern: str = V.PRICE_NUMBER) -> Column:
    """The first number of a price text, thousands commas and bracketed text ignored."""
    plain = F.split_part(F.replace(price, F.lit(","), F.lit("")), F.lit("("), F.lit(1))
    return match(plain, pattern, 1).try_cast("double")


def _parsed(price: Column, quantity: Column, price_pattern: str, quantity_pattern: str) -> Column:
    return F.struct(
        price_number(price, price_pattern).alias("p"),
        match(quantity, quantity_pattern, 1).try_cast("double").alias("q"),
        match(quantity, quantity_pattern, 2).alias("unit"),
    )


def suggested_unit_price(price: Column, quantity: Column) -> Column:
    """Statutory unit price as struct<primary, secondary, amount, unit>; null when it cannot be derived."""

    def row(amount: Column, per: Column, second: Column, second_per: Column) -> Column:
        return F.struct(
            F.concat(F.lit("₹ "), fixed(amount, 2), F.lit(" / "), per).alias("primary"),
            F.concat(F.lit("₹ "), second, F.lit(" / "), second_per).alias("secondary"),
            rounded(amount, 2).alias("amount"),
            per.alias("unit"),
        )

    def priced(p: Column, q: Column, unit: Column) -> Column:
        def small_or_large(small: str, large: str) -> Column:
            in_hundreds = row((p / q) * 100.0, F.lit(f"100 {small}"), fixed(p / q, 2), F.lit(small))
            per_hundred = fixed(rounded((p / q) * 100, 2), 2)
            in_thousands = row(p / (q / 1000.0), F.lit(large), per_hundred, F.lit(f"100 {small}"))
            return F.when(q <= 1000, in_hundreds).otherwise(in_thousands)

        def large_only(small: str, large: str) -> Column:
            return row(p / q, F.lit(large), fixed((p / q) / 10.0, 2), F.lit(f"100 {small}"))

        singular = F.when(
            unit.endswith("s") & (F.length(unit) > 2), F.left(unit, F.length(unit) - 1)
        ).otherwise(unit)
        return (
            F.when(unit == "ml", small_or_large("ml", "L"))
            .when(unit == "L", large_only("ml", "L"))
            .when(unit == "g", small_or_large("g", "kg"))
            .when(unit == "kg", large_only("g", "kg"))
            .when(unit.isin(V.COUNT_UNITS), row(p / q, singular, fixed(p / q, 2), F.lit("unit")))
        )

    return let(
        _parsed(price, quantity, V.PRICE_NUMBER, V.PRICED_QUANTITY),
        lambda v: F.when(
            (v["p"] > 0) & (v["q"] > 0),
            let(standard_unit(v["unit"]), lambda unit: priced(v["p"], v["q"], unit)),
        ),
    )


def client_unit_price(price: Column, quantity: Column) -> Column:
    """The client's variant: array of one or two texts, empty when it cannot be derived."""

    def text(amount: Column, per: str) -> Column:
        return F.concat(F.lit("₹ "), let(amount, half_up_fixed2), F.lit(f" / {per}"))

    def priced(p: Column, q: Column, unit: Column) -> Column:
        ml = F.when(q < 1000, F.array(text((p / q) * 100, "100 ml"), text(p / q, "ml"))).otherwise(
            F.array(text(p / (q / 1000), "L"), text((p / q) * 100, "100 ml"))
        )
        gram = F.when(q < 1000, F.array(text((p / q) * 100, "100 g"), text(p / q, "g"))).otherwise(
            F.array(text(p / (q / 1000), "kg"))
        )
        return (
            F.when(unit.isin("ml", "millilitre", "millilitres"), ml)
            .when(
                unit.isin("l", "ltr", "litre", "litres", "liter"),
                F.array(text(p / q, "L"), text(p / q / 10, "100 ml")),
            )
            .when(unit.isin("g", "gm", "gram", "grams"), gram)
            .when(unit.isin("kg", "kilogram"), F.array(text(p / q, "kg")))
            .when(unit.isin("units", "unit", "pcs", "nos"), F.array(text(p / q, "unit")))
        )

    prices = let(
        _parsed(price, quantity, V.CLIENT_PRICE_NUMBER, V.CLIENT_PRICED_QUANTITY),
        lambda v: F.when((v["p"] > 0) & (v["q"] > 0), priced(v["p"], v["q"], F.lower(v["unit"]))),
    )
    return F.coalesce(prices, F.array().cast("array<string>"))


def with_calculated_unit_price(unit_price: Column, price: Column, quantity: Column) -> Column:
    """The declared unit price, else the suggested one marked as calculated."""
    suggestion = suggested_unit_price(price, quantity)["primary"]
    absent = F.coalesce(unit_price, F.lit("")) == ""
    return F.when(absent, F.concat(suggestion, F.lit(V.CALCULATED_SUFFIX))).otherwise(unit_price)
