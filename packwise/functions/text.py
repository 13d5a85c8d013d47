"""String and number expressions shared by all operators.

All of them are built-in Spark expressions and stay inside code generation,
except `nfkc`, for which Spark has no built-in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V

SPACES = " \t\n\r\x0b\x0c"


def strip(col: Column, chars: str = SPACES) -> Column:
    """Drop any of `chars` from both ends."""
    return F.btrim(col, F.lit(chars))


def match(col: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null where nothing matches.

    `nullif` would run the pattern twice, so '' is dropped from a one-element array instead.
    """
    return F.get(F.array_remove(F.array(F.regexp_extract(col, pattern, group)), ""), F.lit(0))


def has_any(col: Column, words: list[str]) -> Column:
    """True when one of the literal words occurs anywhere in the text."""
    return col.rlike(any_word(words))


def any_word(words: list[str]) -> str:
    """A pattern matching any of the literal words, grouped by first letter so that most positions fail at once."""
    by_first: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        by_first.setdefault(w[0], []).append(w[1:])
    groups = []
    for first, rests in by_first.items():
        tails = "|".join(_escape(r) for r in rests)
        groups.append(_escape(first) + (f"(?:{tails})" if len(rests) > 1 else tails))
    return "|".join(groups)


def _escape(literal: str) -> str:
    """Escapes valid in both Java and RE2."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", literal)


def title_case(col: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(col), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cap = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30)))
    return F.array_join(cap, "")


def fixed(col: Column, places: int) -> Column:
    """Text with a fixed number of decimals, half-even on the exact binary value."""
    return F.call_function("format_number", col, F.lit("0." + "0" * places if places else "0"))


def rounded(col: Column, places: int) -> Column:
    """Round half-even on the exact binary value, as a double."""
    return fixed(col, places).cast("double")


def half_up_fixed2(col: Column) -> Column:
    """Two decimals, exact ties away from zero (ties at two decimals are the odd eighths)."""
    eighths = col * 8
    tie = (eighths == F.floor(eighths)) & (F.pmod(F.floor(eighths), F.lit(8)).isin(1, 5))
    return F.when(tie, fixed(col + 0.001, 2)).otherwise(fixed(col, 2))


def half_up(col: Column) -> Column:
    """Nearest whole number, ties upwards."""
    return F.floor(col + F.lit(0.5)).cast("long")


def known(col: Column) -> Column:
    """The stripped value, or '' when it is null or one of the words for 'missing'."""
    text = strip(F.coalesce(col, F.lit("")))
    return F.when(F.lower(text).isin(V.MISSING_WORDS), F.lit("")).otherwise(text)


def declared(col: Column) -> Column:
    """True when a value is present and is not a word for 'missing'."""
    return known(col) != ""


def fill(template: str, *values: Column) -> Column:
    """A message template with {} replaced by the values in order."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:]):
        out += [value, F.lit(rest)]
    return F.concat(*out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`; expressions have no other way to name a value."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(col: Column) -> Column:
    """Whitespace-separated words without empty ones."""
    return F.regexp_extract_all(col, F.lit(r"(\S+)"), F.lit(1))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalization, Arrow batches at a time."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")
