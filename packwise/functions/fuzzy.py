"""Closed-vocabulary fuzzy matching and repair of numeric text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def nearest(token: Column, vocabulary: list[str], limit: int) -> Column:
    """First vocabulary word with the least edit distance within `limit`, compared in upper case; else null."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    up = F.upper(token)
    scored = F.transform(
        words, lambda w, i: F.struct(F.levenshtein(up, F.upper(w), limit).alias("d"), i.alias("i"), w.alias("w"))
    )
    # min over (distance, position): the first of the closest words
    return F.array_min(F.filter(scored, lambda s: s["d"] >= 0))["w"]


def fuzzy_match(token: Column, vocabulary: list[str], limit: int = 1) -> Column:
    """The nearest vocabulary word (lower-cased for a lower-case token), else the token itself."""
    hit = nearest(token, vocabulary, limit)
    cased = F.when(_is_lower(token), F.lower(hit)).otherwise(hit)
    return F.when(F.length(token) < 2, token).otherwise(F.coalesce(cased, token))


def fuzzy_number(value: Column, candidates: list[str], limit: int = 1) -> Column:
    """The candidate with the least edit distance (case-sensitive) when within `limit`, else the value."""
    words = F.array(*[F.lit(w) for w in candidates])
    scored = F.transform(
        words, lambda w, i: F.struct(F.levenshtein(value, w).alias("d"), i.alias("i"), w.alias("w"))
    )
    best = F.array_min(scored)
    return F.when((F.length(value) > 0) & (best["d"] <= limit), best["w"]).otherwise(value)


def _is_lower(text: Column) -> Column:
    return (F.lower(text) == text) & (F.upper(text) != text)


def _repair_part(part: Column) -> Column:
    token = F.upper(F.regexp_replace(part, r"^[^\w]+|[^\w]+$", ""))
    month = nearest(token, V.MONTH_WORDS, 1)
    unit = nearest(token, V.REPAIR_UNITS, 1)
    confusable = token.rlike(V.CONFUSABLE_ONLY) & (F.length(token) >= 2)
    # coalesce: each step is evaluated once, and only when the ones before gave nothing
    return F.coalesce(
        F.when(token.isin(V.PRESERVED_WORDS), part),
        F.when(F.length(token) == 3, month),
        F.when(F.length(token) >= 4, F.when(_is_lower(part), F.lower(unit)).otherwise(unit)),
        F.when(part.rlike(r"^\p{L}+$") & ~token.isin(V.KNOWN_CORRUPTED), part),
        F.when(part.rlike(r"\d") | confusable, F.translate(part, V.CONFUSABLE_FROM, V.CONFUSABLE_TO)),
        part,
    )


def repair_numeric(text: Column) -> Column:
    """Undo look-alike letters in numbers and misread months and units; words are kept.

    The text is cut at white space and `(),:/-₹` with the cuts kept, each part is
    repaired on its own, and the parts are joined again.  Text that holds only
    digits, cuts and preserved words needs no repair and is passed through.
    """
    parts = F.regexp_extract_all(text, F.lit(V.REPAIR_PARTS), F.lit(1))
    return F.array_join(F.transform(parts, _repair_part), "")
