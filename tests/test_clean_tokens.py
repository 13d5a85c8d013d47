from pyspark.sql import functions as F

from packwise.functions import fixed_values as V
from packwise.operators import tokens as token_ops


def test_filter_keeps_what_is_not_empty_after_cleaning(spark):
    parts = [*V.LONE_NOISE_CHARS, " ", "\t", " ", "​", "\u0001", "", "0", "Rs", "~", "５", "₹", "1O g", "P1:2", "ab", "MRP OO", "　"]
    rows = [(a + b + c, 0.9) for a in parts for b in parts for c in ("", " ", "~", "x")] + [(None, 0.9), ("low", 0.1)]
    tokens = spark.createDataFrame(rows, "text string, confidence double")
    for ascii_only in (False, True):
        cleaned = token_ops.with_clean_text(tokens.where(F.col("confidence") >= V.MIN_TOKEN_CONFIDENCE), ascii_only)
        want = sorted(r.text for r in cleaned.collect() if r.text)
        assert sorted(r.text for r in token_ops.filter_tokens(tokens, ascii_only=ascii_only).collect()) == want


def test_tokens_are_cleaned_once(spark):
    tokens = spark.createDataFrame([("MRP 1OO", 0.9)], "text string, confidence double").repartition(2)
    plan = token_ops.filter_tokens(tokens, ascii_only=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PHONE") <= 1 and plan.count(V.PHONE_LABEL_TYPO[:16]) == 1
