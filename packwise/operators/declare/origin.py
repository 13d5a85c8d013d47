"""Country of origin."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import fixed_values as V
from ...functions.text import any_word, has_any, match, title_case, words_of

AHEAD = 0
LOOKS_AT: list[str] = []
PASS = 1 << 40


def features() -> dict[str, Column]:
    text = F.col("text")
    phrase = f"(?:{any_word(V.ORIGIN_PHRASES)})({any_word(V.PHRASE_COUNTRIES)})"
    return {
        "origin_words": words_of(F.lower(match(text, V.ORIGIN, 1))),
        # list order decides, not the position on the line
        "origin_phrase": F.try_element_at(
            F.array_intersect(
                F.array(*[F.lit(c) for c in V.PHRASE_COUNTRIES]),
                F.regexp_extract_all(F.col("upper"), F.lit(phrase), F.lit(1)),
            ),
            F.lit(1),
        ),
        "origin_place": has_any(F.col("upper"), V.INDIAN_PLACES)
        & (
            (F.col("digits") & text.rlike(V.PIN_5_OR_6))
            | F.col("upper").contains("INDIA")
            | has_any(F.col("upper"), V.CORPORATE_WORDS)
        ),
    }


def steps() -> list[tuple[str, Column]]:
    words = F.col("origin_words")
    two = F.array_join(F.slice(words, 1, 2), " ")
    one = F.try_element_at(words, F.lit(1))
    named = F.when(two.isin(V.LABEL_COUNTRIES), two).when(one.isin(V.LABEL_COUNTRIES), one)
    return [("origin_named", F.coalesce(named, "origin_phrase"))]


def candidates() -> list[tuple[str, Column, Column]]:
    named = F.col("origin_named")
    rank = F.col("line_no") + F.when(named.isNull(), F.lit(PASS)).otherwise(F.lit(0))
    value = F.when(named.isNotNull(), title_case(named)).when(F.col("origin_place"), F.lit("India"))
    return [("", rank.cast("long"), value)]
