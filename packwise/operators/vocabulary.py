"""Nearest words from a vocabulary that is a table: the matching of `functions.fuzzy` without a step over all pairs.

Two words within k edits become equal after at most k deletions from each, so both sides are given all their variants with
up to k letters deleted, and an equi-join on the hash of a variant finds every pair within k; the exact distance then
decides. Words of more than LONG letters have too many variants: the vocabulary word is cut into k + 1 even segments, one
of which any word within k edits holds unchanged and shifted by at most k, and the join is on (length, segment number,
segment). A pair of which one word is long and one is not is found by segments, too.

Tokens are reduced to different ones before the join, so a token that fills a third of the rows costs one row there; what
is found is joined back to the rows. Nothing is collected or broadcast by hint.

Defined cases: null tokens and words match nothing and null tokens stay null; words that repeat count once, with their lowest
rank; equal distances go to the lowest (rank, word); an empty vocabulary leaves every token as it is; texts of any length
take part; a column of the tokens that has the name of the result is replaced, other names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import _is_lower

LONG = 24


def _without_one(word: Column) -> Column:
    n = F.length(word)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))


def variants(word: Column, limit: int) -> Column:
    """The word and all that is left of it after up to `limit` deletions."""
    every = level = F.array(word)
    for _ in range(limit):
        level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        every = F.array_union(every, level)
    return every


def _segment(text: Column, size: Column, part: Column, shift: Column, limit: int) -> Column:
    """Hash of (size, part, the letters of `text` where a word of that size has its part, shifted); null outside."""
    start = F.floor(part * size / (limit + 1)).cast("int")
    length = F.floor((part + 1) * size / (limit + 1)).cast("int") - start
    inside = (start + shift >= 0) & (start + shift + length <= F.length(text))
    return F.when(inside, F.xxhash64(size, part, F.substring(text, start + shift + 1, length)))


def _keys(text: Column, limit: int, of_vocabulary: bool) -> Column:
    """Join keys: two texts within `limit` edits share at least one."""
    n, parts = F.length(text), F.sequence(F.lit(0), F.lit(limit))
    if of_vocabulary:
        segments = F.transform(parts, lambda p: _segment(text, n, p, F.lit(0), limit))
    else:
        around = F.sequence(F.lit(-limit), F.lit(limit))
        segments = F.flatten(F.transform(around, lambda more: F.flatten(F.transform(parts, lambda p: F.transform(
            around, lambda shift: _segment(text, n + more, p, shift, limit))))))
    none = F.array().cast("array<bigint>")
    short = F.when(n <= LONG, F.transform(variants(text, limit), lambda v: F.xxhash64(v))).otherwise(none)
    return F.array_distinct(F.concat(short, F.when(n > LONG - limit, F.array_compact(segments)).otherwise(none)))


def nearest_in(
    tokens: DataFrame, vocabulary: DataFrame, token: str, word: str, limit: int = 1, rank: str | None = None, upper: bool = True
) -> DataFrame:
    """(__token, __hit): for each different token the nearest word within `limit` edits; tokens without one are left out.

    upper: distances are those of the upper-case forms. rank: a column of the vocabulary that orders words at equal distance.
    """
    if not 0 <= limit < LONG:
        raise ValueError(f"limit must be at least 0 and less than {LONG}")

    def form(column: str) -> Column:
        return F.upper(column) if upper else F.col(column)

    order = F.col(rank) if rank else F.lit(0)
    words = vocabulary.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("__word")).agg(F.min(order).alias("__rank"))
    asked = tokens.where(F.col(token).isNotNull()).select(F.col(token).alias("__token")).distinct()
    left = asked.withColumn("__a", form("__token")).withColumn("__key", F.explode(_keys(F.col("__a"), limit, False)))
    right = words.withColumn("__b", form("__word")).withColumn("__key", F.explode(_keys(F.col("__b"), limit, True)))
    pairs = left.join(right, "__key").withColumn("__d", F.levenshtein("__a", "__b", limit)).where("__d >= 0")
    best = pairs.groupBy("__token").agg(F.min(F.struct("__d", "__rank", "__word")).alias("__best"))
    return best.select("__token", F.col("__best.__word").alias("__hit"))


def _joined_back(tokens: DataFrame, found: DataFrame, token: str, value: Column, name: str) -> DataFrame:
    kept = [F.col(f"t.`{c}`") for c in tokens.columns if c != name]
    return tokens.alias("t").join(found, F.col(f"t.`{token}`") == F.col("__token"), "left").select(*kept, value.alias(name))


def match_words(
    tokens: DataFrame, vocabulary: DataFrame, token: str = "word", word: str = "word", limit: int = 1, rank: str | None = None, name: str = "matched"
) -> DataFrame:
    """Add the nearest word of the table, lower-cased for a lower-case token, else the token; one letter is not matched."""
    found = nearest_in(tokens.where(F.length(token) >= 2), vocabulary, token, word, limit, rank)
    own, hit = F.col(f"t.`{token}`"), F.col("__hit")
    return _joined_back(tokens, found, token, F.coalesce(F.when(_is_lower(own), F.lower(hit)).otherwise(hit), own), name)


def match_numbers(
    tokens: DataFrame, candidates: DataFrame, token: str = "value", word: str = "value", limit: int = 1, rank: str | None = None, name: str = "matched"
) -> DataFrame:
    """Add the nearest candidate, compared as written, else the value; an empty value is not matched."""
    found = nearest_in(tokens.where(F.length(token) > 0), candidates, token, word, limit, rank, upper=False)
    return _joined_back(tokens, found, token, F.coalesce(F.col("__hit"), F.col(f"t.`{token}`")), name)
