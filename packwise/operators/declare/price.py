"""Maximum retail price."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import has_any, match

AHEAD = 3
LOOKS_AT = ["tax", "ahead_amount"]


def _number(amount: Column) -> Column:
    return F.replace(amount, F.lit(","), F.lit("")).try_cast("double")


def features() -> dict[str, Column]:
    text = F.col("text")
    skipped = has_any(F.col("upper"), V.AHEAD_PRICE_SKIP) | text.rlike(V.DATE_LIKE)
    amount = F.when(
        ~skipped,
        F.coalesce(match(text, V.CURRENCY_AMOUNT, 1), match(text, V.SLASH_AMOUNT, 1), match(text, V.BARE_AMOUNT, 1)),
    )
    plausible = (_number(amount) >= V.MIN_PLAUSIBLE_PRICE) | has_any(text, V.AHEAD_PRICE_MARKS)
    return {
        "tax": F.col("upper").contains("TAX"),
        "ahead_amount": F.when(F.col("digits"), F.when(plausible, amount)),
    }


def steps() -> list[tuple[str, Column]]:
    text, keyword = F.col("text"), F.col("price_key")
    return [
        ("price_key", text.rlike(V.MRP_KEYWORD)),
        ("price_full", F.when(keyword & F.col("digits"), match(text, V.MRP_FULL, 1))),
        (
            "price_apart",
            F.when(
                keyword,
                F.coalesce(
                    match(text, V.CURRENCY_AMOUNT, 1),
                    match(text, V.SLASH_AMOUNT, 1),
                    *[F.col(f"next{k}")["ahead_amount"] for k in (1, 2, 3)],
                ),
            ),
        ),
    ]


def candidates() -> list[tuple[str, Column, Column]]:
    text, full, apart = F.col("text"), F.col("price_full"), F.col("price_apart")
    taxed = F.col("tax")
    for k in (1, 2, 3):
        taxed = taxed | F.coalesce(F.col(f"next{k}")["tax"], F.lit(False))
    suffix = F.when(taxed, F.lit(V.TAX_SUFFIX)).otherwise("")
    plausible = (_number(full) >= V.MIN_PLAUSIBLE_PRICE) | has_any(text, V.PRICE_MARKS)
    currency = F.when(text.contains("₹"), F.lit("₹ ")).otherwise("Rs. ")
    value = F.coalesce(
        F.when(plausible, F.concat(currency, full, suffix)),
        F.concat(F.lit("₹ "), apart, suffix),
    )
    return [("", F.col("line_no").cast("long"), value)]
