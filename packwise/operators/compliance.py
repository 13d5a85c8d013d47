"""Status, score, violations and confidence of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import rounded

EXACT = "decimal(20,12)"  # confidences are summed exactly, so the order of the sum does not matter


def _with_status(results: Column, *states: str) -> Column:
    return F.filter(results, lambda r: r["status"].isin(*states))


def status_of(results: Column) -> Column:
    return (
        F.when(F.exists(results, lambda r: r["status"] == "FAIL"), F.lit("FAIL"))
        .when(F.exists(results, lambda r: r["status"] == "REVIEW"), F.lit("REVIEW"))
        .otherwise("PASS")
    )


def score_of(results: Column) -> Column:
    """Passed over applicable rules, four decimals; 0 when no rule applies."""
    applicable = F.size(_with_status(results, "PASS", "FAIL", "REVIEW"))
    passed = F.size(_with_status(results, "PASS"))
    return F.when(applicable > 0, rounded(passed / applicable, 4)).otherwise(F.lit(0.0))


def violations_of(results: Column) -> Column:
    """`name: reason` of every failed or doubtful rule in rule order."""
    return F.transform(
        _with_status(results, "FAIL", "REVIEW"),
        lambda r: F.when(F.coalesce(r["reason"], F.lit("")) != "", F.concat(r["name"], F.lit(": "), r["reason"])).otherwise(
            r["name"]
        ),
    )


def review_count(results: Column) -> Column:
    return F.size(_with_status(results, "REVIEW"))


def confidence_of(mean_confidence: Column, reviews: Column) -> Column:
    """Mean token confidence (or the default) less a penalty per doubtful rule, not below 0, four decimals."""
    base = F.coalesce(mean_confidence, F.lit(V.DEFAULT_CONFIDENCE))
    return rounded(F.greatest(F.lit(0.0), base - reviews * F.lit(V.REVIEW_PENALTY)), 4)


def mean_positive(confidence: Column) -> Column:
    """Aggregate: mean of the positive confidences, null when there is none."""
    kept = F.when(confidence > 0, confidence)
    return F.sum(kept.cast(EXACT)).cast("double") / F.nullif(F.count(kept), F.lit(0))


def with_compliance(evaluated: DataFrame, mean_confidence: str) -> DataFrame:
    """Records with rule results plus status, score, violations and confidence (no shuffle)."""
    r = F.col("rule_results")
    return evaluated.select(
        "*",
        status_of(r).alias("status"),
        score_of(r).alias("score"),
        violations_of(r).alias("violations"),
        confidence_of(F.col(mean_confidence), review_count(r)).alias("confidence"),
    )


def rollup_long(long: DataFrame, keys: list[str]) -> DataFrame:
    """The same status and score from the one-row-per-rule form."""
    counts = long.groupBy(*keys).agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "REVIEW").alias("reviews"),
    )
    applicable = F.col("passed") + F.col("failed") + F.col("reviews")
    return counts.select(
        *keys,
        "passed", "failed", "reviews",
        F.when(F.col("failed") > 0, F.lit("FAIL")).when(F.col("reviews") > 0, F.lit("REVIEW")).otherwise("PASS").alias("status"),
        F.when(applicable > 0, rounded(F.col("passed") / applicable, 4)).otherwise(F.lit(0.0)).alias("score"),
    )
