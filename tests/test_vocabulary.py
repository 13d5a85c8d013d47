"""The deletion-neighbourhood join against the all-pairs form."""

import random

import pytest
from pyspark.sql import functions as F

from packwise.functions import fuzzy
from packwise.operators import vocabulary


def _edited(rng, word, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
        word = word[:at] + ("" if kind == 0 else rng.choice("abé")) + word[at + (kind != 1):]
    return word


@pytest.mark.parametrize("limit", [1, 2])
def test_equals_all_pairs(spark, limit):
    rng = random.Random(limit)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 5, 8, 22, 23, 24, 25, 26, 40]))) for _ in range(60)] + ["", "Ab", "AB", "ab"]
    tokens = [_edited(rng, rng.choice(words), rng.randrange(4)) for _ in range(400)] + ["", "x", "ABC", "aB"]
    tokens = [t.upper() if i % 3 == 0 else t for i, t in enumerate(tokens)]
    words = list(dict.fromkeys(words))
    asked = spark.createDataFrame([(t,) for t in tokens], "word string")
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, place int")
    want = asked.select("word", fuzzy.fuzzy_match(F.col("word"), words, limit).alias("matched"))
    got = vocabulary.match_words(asked, table, limit=limit, rank="place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = asked.select("word", fuzzy.fuzzy_number(F.col("word"), words, limit).alias("matched"))
    got = vocabulary.match_numbers(asked, table, "word", "word", limit, "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    long = "lang" * 20_000
    asked = spark.createDataFrame([(None, 1, "k"), ("colr", 2, "k"), ("colr", 3, "k"), ("x" + long, 4, "k"), ("far off", 5, "k")], "word string, __x int, matched string")
    table = spark.createDataFrame([("COLOR", "b"), ("COLOR", "a"), ("COLT", "b"), (None, "a"), (long, "z")], "word string, matched string")
    got = {r["__x"]: r.matched for r in vocabulary.match_words(asked, table, rank="matched").collect()}
    assert got == {1: None, 2: "color", 3: "color", 4: long, 5: "far off"}
    same = vocabulary.match_words(asked, table.limit(0))
    assert {r["__x"]: r.matched for r in same.collect()}[2] == "colr" and vocabulary.match_words(asked.limit(0), table).count() == 0
    plan = same._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
