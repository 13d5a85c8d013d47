"""Store round trips, idempotent upserts, and the stream against the batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from packwise.operators.tokens import telemetry
from packwise.plans import search
from packwise.plans.analytics import measures, percentage
from packwise.sources import store, version_log
from packwise.streaming import live_kpis

SCHEMA = "inspection_id string, version int, created_at timestamp, status string, violation_count int, confidence double"


def _rows(version, status, numbers):
    return [(f"I{i}", version, dt.datetime(2024, 1 + i % 3, 1 + i % 20), status, i % 4, 0.5) for i in numbers]


def _log(spark, path):
    return version_log.VersionLog(spark, str(path), SCHEMA, summed=True)


def _state(log):
    return {r.inspection_id: (r.version, r.status) for r in log.snapshot().collect()}


def _numbers_agree(log):
    want = measures(log.snapshot().withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), ["day"])
    got = log.measures(["day"]).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_equals_batch(spark, tmp_path):
    """Several micro-batches, re-submissions in later ones, a repeated delivery, and a restart in between."""
    source, work, log = str(tmp_path / "in"), str(tmp_path / "work"), _log(spark, tmp_path / "log")
    parts = [_rows(1, "PASS", range(30)), _rows(2, "FAIL", range(0, 30, 4)), _rows(1, "REVIEW", range(25, 35))]
    for run in (parts[:2], parts[2:], [_rows(2, "FAIL", range(0, 30, 4)), _rows(3, "PASS", [4])]):
        for rows in run:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        live_kpis.start(stream, log, work).awaitTermination()
        _numbers_agree(log)
    assert len([c for c in log.commits() if c.source]) == 5
    state = _state(log)
    assert len(state) == 35 and state["I4"] == (3, "PASS") and state["I8"] == (2, "FAIL") and state["I1"] == (1, "PASS")
    assert live_kpis.read_kpis(log).agg(F.sum("total")).first()[0] == 35


def test_log_keeps_every_write_and_reads_one_state(spark, tmp_path):
    log = _log(spark, tmp_path / "log")
    assert log.snapshot().count() == 0 and log.measures().first().total == 0
    log.upsert(spark.createDataFrame(_rows(1, "PASS", range(40)), SCHEMA))
    moved = [(i, v, d.replace(month=7), s, n, c) for i, v, d, s, n, c in _rows(2, "FAIL", range(0, 40, 3))]
    log.upsert(spark.createDataFrame(moved + _rows(1, "REVIEW", [41]), SCHEMA))  # a new date moves no row and leaves none behind
    state = _state(log)
    assert len(state) == 41 == log.snapshot().count() and state["I3"] == (2, "FAIL") and state["I41"] == (1, "REVIEW")
    _numbers_agree(log)
    before = log.snapshot()  # a reader that has begun
    log.compact()
    assert len(log.live()) == 1 and _state(log) == state and {r.inspection_id for r in before.collect()} == set(state)
    log.upsert(spark.createDataFrame(_rows(1, "REVIEW", [3, 50]), SCHEMA))  # an old version comes late
    assert _state(log) == state | {"I50": (1, "REVIEW")}
    _numbers_agree(log)
    assert log.upsert(before.limit(1).drop("month"), source="a") and not log.upsert(before.limit(1).drop("month"), source="a")


def test_a_write_that_is_not_published_is_not_read(spark, tmp_path):
    log = _log(spark, tmp_path / "log")
    log.upsert(spark.createDataFrame(_rows(1, "PASS", range(5)), SCHEMA))
    log._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    for write in (lambda: log.upsert(spark.createDataFrame(_rows(2, "FAIL", range(5)), SCHEMA)), lambda: log.delete(log.snapshot(), None, True, [])):
        with pytest.raises(RuntimeError):
            write()
    assert set(_state(_log(spark, tmp_path / "log")).values()) == {(1, "PASS")}
    _numbers_agree(_log(spark, tmp_path / "log"))


def test_deleted_records_are_gone_and_stay_so(spark, tmp_path):
    schema = SCHEMA + ", user_id string"
    rows = [(*r, f"u{i % 2}") for i, r in enumerate(_rows(1, "PASS", range(20)))]
    log = version_log.VersionLog(spark, str(tmp_path / "log"), schema, summed=True)
    log.upsert(spark.createDataFrame(rows, schema))
    ids = log.snapshot().where("inspection_id in ('I2', 'I3', 'I4')").select("inspection_id")
    assert log.delete(ids, "u9", False, ["user_id"]) == 0 and len(log.commits()) == 1
    assert log.delete(ids, "u0", False, ["user_id"]) == 2
    for _ in range(2):
        assert set(_state(log)) == {f"I{i}" for i in range(20)} - {"I2", "I4"}
        assert search.page(log.snapshot(), 1, 20).count() == 18 and log.measures().first().total == 18
        _numbers_agree(log)
        log.compact()
    log.upsert(spark.createDataFrame([r for r in rows if r[0] in ("I0", "I4")], schema).withColumn("version", F.expr("if(inspection_id = 'I0', 0, 2)")))
    assert _state(log)["I4"] == (2, "PASS") and _state(log)["I0"] == (1, "PASS") and "I2" not in _state(log)
    _numbers_agree(log)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_only_touched_months_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(spark.createDataFrame(_rows(1, "PASS", range(40)), SCHEMA), path)
    months = store.months_of(store.with_month(spark.createDataFrame(_rows(2, "FAIL", [0, 3]), SCHEMA)))
    assert months == ["2024-01"]
    chosen = store.of_months(store.scan(spark, path), months)
    assert "PartitionFilters: [isnotnull(month" in _plan(chosen) and {r["month"] for r in chosen.collect()} == {"2024-01"}
    after = search.page_after(store.scan(spark, path), F.lit(dt.datetime(2024, 2, 5)), F.lit("I1"))
    assert "PartitionFilters: [isnotnull(month" in _plan(after)
    assert all(r["created_at"] <= dt.datetime(2024, 2, 5) for r in after.collect())


def test_equal_versions_always_give_the_same_row(spark):
    rows = [(f"I{i % 5}", 1, dt.datetime(2024, 1, 1), f"S{i}", i, 0.5) for i in range(200)]
    first = sorted(store.latest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert first == sorted(store.latest(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect())


def test_empty_percentages_are_zero(spark):
    df = spark.createDataFrame([("",), ("0.5",), ("x",), (None,), (" 70 ",)], "v string")
    assert [r[0] for r in df.select(percentage(F.col("v"))).collect()] == [0, 50, None, None, 70]


def test_telemetry_keeps_empty_panels(spark):
    panels = spark.createDataFrame([(1, 1), (1, 2)], "insp_no long, panel_no long")
    tokens = spark.createDataFrame([(1, 1, 0.5), (1, 1, 1.0)], "insp_no long, panel_no long, confidence double")
    assert sorted(map(tuple, telemetry(panels, tokens).collect())) == [(1, 1, 2, 0.75), (1, 2, 0, 1.0)]


def _rows_read(df) -> int:
    """Rows that the scans of a plan gave, after row groups were skipped."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        if "AdaptiveSparkPlan" in node.nodeName():
            waiting.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            waiting.append(node.plan())
        children = node.children()
        waiting.extend(children.apply(i) for i in range(children.length()))
    return found


def test_lookup_by_id_skips_row_groups_and_keeps_to_the_owner(spark, tmp_path):
    schema = "inspection_id string, version int, created_at timestamp, user_no long, status string"
    rows = spark.range(60_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("inspection_id"), F.lit(1).alias("version"),
        F.make_timestamp(F.lit(2024), (F.col("id") % 6 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"), (F.col("id") % 9).alias("user_no"), F.lit("FAIL").alias("status"),
    )
    log = version_log.VersionLog(spark, str(tmp_path / "log"), schema)
    log.upsert(rows)
    ids = [r.inspection_id for r in rows.where("id in (7, 16, 25, 8)").orderBy((F.col("id") == 8), "created_at").collect()]
    mine, other = ids[:3], ids[3]
    assert {r.inspection_id for r in log.lookup(ids, 7, False, ["user_no"]).collect()} == set(mine)
    assert log.lookup(ids, 1, True, ["user_no"]).count() == 4 and log.lookup([other], 7, False, ["user_no"]).count() == 0
    log.upsert(rows.where(F.col("inspection_id") == mine[0]).withColumn("version", F.lit(2)).withColumn("status", F.lit("PASS")))
    assert log.delete(rows.where(F.col("inspection_id") == mine[1]), 7, False, ["user_no"]) == 1
    left = {r.inspection_id: r.status for r in log.lookup(ids, 7, False, ["user_no"]).collect()}
    assert left == {mine[0]: "PASS", mine[2]: "FAIL"}
    absent = "8" * 64  # between the least and the largest id of every file
    assert log.lookup([absent], 1, True, []).count() == 0 and _rows_read(log.lookup([absent], 1, True, [])) == 0
    assert 0 < _rows_read(log.lookup([mine[2]], 1, True, [])) <= 10_000
