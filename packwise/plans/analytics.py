"""Dashboard numbers over evaluated records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import half_up, rounded

EXACT = "decimal(20,12)"

# published key -> measure
KPI_ALIASES = {
    "total_inspections": "total", "total": "total",
    "compliant_count": "passed", "compliant": "passed", "pass_count": "passed",
    "violations_count": "failed", "non_compliant": "failed", "fail_count": "failed",
    "review_count": "review", "review": "review",
    "compliance_rate_pct": "rate", "compliance_rate": "rate",
    "total_violations_flagged": "violations", "recent_alerts": "violations",
    "average_confidence": "confidence", "confidence": "confidence",
}


def measures(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, compliance rate and mean confidence in percent (one decimal), number of violations."""
    total = F.count(F.lit(1))
    passed = F.count_if(F.col("status") == "PASS")
    confidence = F.sum(F.col("confidence").cast(EXACT)).cast("double") / F.nullif(F.count("confidence"), F.lit(0))
    return records.groupBy(*(by or [])).agg(
        total.alias("total"),
        passed.alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "REVIEW").alias("review"),
        F.coalesce(rounded(passed / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0)).alias("rate"),
        F.coalesce(F.sum("violation_count"), F.lit(0)).alias("violations"),
        F.coalesce(rounded(confidence * 100, 1), F.lit(0.0)).alias("confidence"),
    )


#: numbers that add up over parts of the records, and their types
SUMS = {
    "total": "long", "passed": "long", "failed": "long", "review": "long", "violations": "long", "confidences": "long",
    "confidence_sum": "decimal(38,12)",
}


def measure_sums(records: DataFrame, by: list[str]) -> DataFrame:
    """The parts of `measures` that can be added and taken away."""
    made = {
        "total": F.count(F.lit(1)), "violations": F.coalesce(F.sum("violation_count"), F.lit(0)), "confidences": F.count("confidence"),
        "confidence_sum": F.coalesce(F.sum(F.col("confidence").cast(EXACT)), F.lit(0)),
    } | {c: F.count_if(F.col("status") == status) for c, status in (("passed", "PASS"), ("failed", "FAIL"), ("review", "REVIEW"))}
    return records.groupBy(*by).agg(*[made[c].cast(t).alias(c) for c, t in SUMS.items()])


def measures_of(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`measures` from sums of parts."""
    added = sums.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in SUMS.items()])
    confidence = F.col("confidence_sum").cast("double") / F.nullif(F.col("confidences"), F.lit(0))
    return added.select(
        *(by or []), "total", "passed", "failed", "review",
        F.coalesce(rounded(F.col("passed") / F.nullif(F.col("total"), F.lit(0)) * 100, 1), F.lit(0.0)).alias("rate"),
        "violations",
        F.coalesce(rounded(confidence * 100, 1), F.lit(0.0)).alias("confidence"),
    )


def dashboard(records: DataFrame) -> DataFrame:
    """One row with every published key, over all records."""
    return published(measures(records))


def published(m: DataFrame) -> DataFrame:
    """Measures under every published key."""
    return m.select(*[F.col(measure).alias(key) for key, measure in KPI_ALIASES.items()])


def client_stats(records: DataFrame) -> DataFrame:
    """The client's own numbers: status compared in upper case, rate not rounded."""
    status = F.upper(F.coalesce("status", F.lit("")))
    total, passed = F.count(F.lit(1)), F.count_if(status == "PASS")
    return records.agg(
        total.alias("total"),
        passed.alias("pass"),
        F.count_if(status == "FAIL").alias("fail"),
        F.count_if(status == "REVIEW").alias("review"),
        F.coalesce(passed / F.nullif(total, F.lit(0)) * 100, F.lit(0.0)).alias("rate"),
        F.coalesce(F.sum("violation_count"), F.lit(0)).alias("alerts"),
    )


# where the client looks for each number, in order
CLIENT_KEYS = {
    "total": ["total", "total_inspections", "inspections_count"],
    "pass": ["compliant", "passed", "pass_count", "compliant_count"],
    "fail": ["non_compliant", "failed", "fail_count", "violations_count"],
    "review": ["review", "review_count"],
    "rate": ["compliance_rate", "compliance_rate_pct", "complianceRate"],
    "alerts": ["recent_alerts", "alerts", "total_violations_flagged"],
}


def normalized_stats(stats: DataFrame) -> DataFrame:
    """A statistics row under any of its known key names, as the client's six numbers."""
    out = []
    for name, keys in CLIENT_KEYS.items():
        have = [F.col(k) for k in keys if k in stats.columns]
        out.append(F.coalesce(*have, F.lit(0)).alias(name))
    return stats.select(*out)


def rule_counts(long: DataFrame) -> DataFrame:
    """How often each rule failed or was doubtful."""
    return long.where(F.col("status").isin("FAIL", "REVIEW")).groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def most_violated(long: DataFrame, top: int = 8) -> DataFrame:
    """The `top` rules by count; ties in order of first appearance (newest record first, then rule order)."""
    hits = long.where(F.col("status").isin("FAIL", "REVIEW"))
    counted = hits.groupBy("name").agg(
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "inspection_id", "rule_no")).alias("first"),
    )
    best = counted.orderBy(F.desc("count"), "first").limit(top)
    return best.select(F.col("name").alias("rule"), "count")


def recent_violations(records: DataFrame, top: int = 8) -> DataFrame:
    """The first `top` violation texts, newest record first."""
    spread = records.select("created_at", "inspection_id", F.posexplode("violations").alias("pos", "violation"))
    return spread.orderBy(F.desc("created_at"), "inspection_id", "pos").limit(top)


def by_category(records: DataFrame) -> DataFrame:
    """Records per category with the rounded share of all."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(V.DEFAULT_CATEGORY))
    counts = records.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("count"))
    # one row per category is left, so a window over all of them is small
    share = F.col("count") / F.greatest(F.sum("count").over(Window.partitionBy()), F.lit(1)) * 100
    return counts.select("category", "count", half_up(share).alias("percent"))


def bucket_of(name: Column) -> Column:
    """Chart bucket of a rule name."""
    chain = reduce(
        lambda acc, b: acc.when(name.rlike(b[1]), F.lit(b[0])), V.VIOLATION_BUCKETS[:-1], F
    )
    return chain.otherwise(V.VIOLATION_BUCKETS[-1][0])


def violation_buckets(outcomes: DataFrame) -> DataFrame:
    """Not-obeyed rules per chart bucket, zero-filled, with bar length in percent of the longest."""
    seed = outcomes.sparkSession.createDataFrame(
        [(i, b[0]) for i, b in enumerate(V.VIOLATION_BUCKETS, 1)], "bucket_no int, bucket string"
    )
    counts = outcomes.where(F.col("outcome") == "not_obeyed").groupBy(bucket_of(F.col("name")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    filled = seed.join(counts, "bucket", "left").withColumn("count", F.coalesce("n", F.lit(0)))
    longest = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    return filled.select("bucket_no", "bucket", "count", half_up(F.col("count") / longest * 100).alias("percent"))


def outcomes_from_rules(long: DataFrame, keys: list[str]) -> DataFrame:
    """Obeyed / not obeyed / review per rule row; a rule that does not apply counts as review here."""
    state = F.upper(F.coalesce("status", F.lit("")))
    return long.select(
        *keys,
        "rule_no",
        "name",
        "reason",
        F.when(state == "PASS", F.lit("obeyed")).when(state == "FAIL", F.lit("not_obeyed")).otherwise("review").alias(
            "outcome"
        ),
    )


def outcomes_from_fields(records: DataFrame, keys: list[str]) -> DataFrame:
    """The same summary for records stored without rule rows.

    Eight clauses from the fields, the letter height, and every violation text that no
    listed failure already covers; for a REVIEW record the first failure is shown as review.
    """
    clauses = F.array(
        *[
            F.struct(
                F.lit(clause).alias("clause"), F.lit(name).alias("name"),
                F.when(_clause_met(F.col(field)), F.lit("obeyed")).otherwise("not_obeyed").alias("outcome"),
                F.when(_clause_met(F.col(field)), F.lit("Declared and verified on packaging")).otherwise(reason).alias(
                    "reason"
                ),
            )
            for field, clause, name, reason in V.CLAUSES
        ]
    )
    h = F.col("font_height")
    tall = h >= 1.0
    shown = F.regexp_replace(h.cast("string"), r"\.0$", "")
    font = F.struct(
        F.lit(V.FONT_CLAUSE[0]).alias("clause"), F.lit(V.FONT_CLAUSE[1]).alias("name"),
        F.when(tall, F.lit("obeyed")).otherwise("not_obeyed").alias("outcome"),
        F.when(tall, F.concat(F.lit("Compliant height: "), shown, F.lit(" mm (≥ 1.0 mm)"))).otherwise(
            F.concat(F.lit("Font height "), shown, F.lit(" mm is below statutory 1.0 mm minimum."))
        ).alias("reason"),
    )
    stated = records.withColumn(
        "__base",
        F.concat(clauses, F.when(F.coalesce(h, F.lit(0.0)) != 0, F.array(font)).otherwise(F.array().cast(_OUTCOMES))),
    )

    def covered(failure: Column, text: Column) -> Column:
        low = F.lower(text)
        return F.lower(failure["name"]).contains(low) | low.contains(F.lower(failure["clause"]))

    def add(acc: Column, text: Column) -> Column:
        failures = F.filter(acc, lambda o: o["outcome"] == "not_obeyed")
        fresh = (F.coalesce(text, F.lit("")) != "") & ~F.exists(failures, lambda f: covered(f, text))
        row = F.struct(
            F.lit("Infringement").alias("clause"), text.alias("name"), F.lit("not_obeyed").alias("outcome"),
            F.lit("Statutory violation flagged during inspection").alias("reason"),
        )
        return F.when(fresh, F.concat(acc, F.array(row))).otherwise(acc)

    listed = F.aggregate(F.coalesce("violations", F.array().cast("array<string>")), F.col("__base"), add)
    # the first failure of a REVIEW record moves to review; it is found in the list, before rows are made of it
    rows = stated.withColumn("__all", listed).withColumn(
        "__first", F.array_position(F.transform("__all", lambda o: o["outcome"]), F.lit("not_obeyed")) - 1
    )
    rows = rows.select(*keys, "status", "__first", F.posexplode("__all").alias("pos", "o"))
    moved = (F.col("status") == "REVIEW") & (F.col("pos") == F.col("__first"))
    return rows.select(
        *keys,
        (F.col("pos") + 1).alias("rule_no"),
        F.col("o.name").alias("name"),
        F.col("o.reason").alias("reason"),
        F.when(moved, F.lit("review")).otherwise(F.col("o.outcome")).alias("outcome"),
    )


_OUTCOMES = "array<struct<clause:string,name:string,outcome:string,reason:string>>"


def _clause_met(value: Column) -> Column:
    return F.coalesce((F.trim(value) != "") & ~value.rlike(V.CLAUSE_ABSENT), F.lit(False))


def percentage(value: Column) -> Column:
    """A ratio or a percentage as whole percent between 0 and 100; null when it is not a number."""
    text = F.trim(value.cast("string"))
    n = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))  # an empty text counts as zero
    whole = half_up(F.when(n <= 1, n * 100).otherwise(n))
    # least and greatest skip nulls, so a missing number has to be kept apart
    return F.when(n.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), whole)))


def shown_score(score: Column, obeyed: Column, rules: Column) -> Column:
    """Score in percent: the stored one, else obeyed over all rules."""
    return F.coalesce(
        percentage(score), F.when(rules > 0, half_up(obeyed / rules * 100)).otherwise(F.lit(0).cast("long"))
    )


def shown_confidence(confidence: Column, token_confidence: Column) -> Column:
    """Confidence in percent: the stored one, else the mean of the token confidences."""
    return F.coalesce(percentage(confidence), half_up(token_confidence * 100), F.lit(0).cast("long"))


def score_band(percent: Column) -> Column:
    return F.when(percent >= 80, F.lit("compliant")).when(percent >= 50, F.lit("needs review")).otherwise(
        "non-compliant"
    )


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 80, F.lit("High Certainty")).when(percent >= 60, F.lit("Moderate")).otherwise(
        "Low Certainty"
    )
