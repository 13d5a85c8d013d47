import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, rows_of
from packwise.llm import hard_negatives as hn
from packwise.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, scale, positives=5, negatives=5, low=80, high=100):
    kept = [
        (i, lab, [math.floor(scale * x) for x in v])
        for i, v, lab in rows
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x * scale) for x in v)
    ]
    out = []
    for a, (i, lab, q) in enumerate(kept):
        if not is_anchor(i):
            continue
        scored = [(min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1), j, other) for b, (j, other, v) in enumerate(kept) if b != a]
        own = sorted((-s, j) for s, j, other in scored if other == lab)[:positives]
        for s, j in own:
            fit = sorted((-t, k) for t, k, other in scored if other != lab and low * -s <= 100 * t <= high * -s)[:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def _rows(seed, n, dims, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    made = []
    for i in range(n):
        v = (centres[rng.integers(5)] + 0.5 * rng.normal(size=dims)) * rng.choice([0.01, 0.3, 1, 1, 2, 40])
        made.append((i, v.tolist(), int(rng.choice([0, 0, 0, *range(labels)]))))
    return made


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, dict(block=40, chunk=3, bucket=8)), (3, dict(block=7, chunk=2, bucket=3, focus=2))])
def test_equals_brute_force(spark, seed, sizes):
    rows = _rows(seed, 260, 6, 12)
    rows += [(500, None, 1), (501, [], 1), (502, [0.1] * 6, None), (None, [0.1] * 6, 1), (503, [float("inf")] * 6, 1), (504, [1e308] * 6, 1), (505, [0.5, None, 1.0, 1.0, 1.0, 1.0], 2)]
    rows += [(600 + i, [0.0] * 6, i % 2) for i in range(4)] + [(700 + i % 3, rows[5][1], i % 4) for i in range(30)] + [(800, [0.7], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("uid", F.lit("x")).withColumn("class", F.lit(1))
    found = hn.mined(df, F.col("id") % 10 == 0, scale=16, least_block=1, least_chunk=1, **sizes)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 10 == 0, 16)


def test_components_of_any_size(spark):
    rows = [(i, [x, 1.0], i % 2) for i, x in enumerate([1e9, 2e9, 3e9, 1e30, 2e30, 4e9, 5.0, 7.0, 9.5e8, 1e9])]
    found = hn.mined(spark.createDataFrame(rows, SCHEMA), F.col("id") < 10, scale=256)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i < 10, 256)


def test_empty_tables_and_text_labels(spark):
    rows = _rows(5, 60, 4, 3)
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mined(empty, F.col("id") % 2 == 0).count() == 0
    assert hn.mined(spark.createDataFrame(rows, SCHEMA), F.col("id") < 0).count() == 0
    named = spark.createDataFrame([(i, v, f"name {lab}") for i, v, lab in rows], "vec_id long, embedding array<double>, label string")
    assert sorted(map(tuple, hn.mined(named, F.col("id") % 7 == 0).collect())) == brute(rows, lambda i: i % 7 == 0, 256)


def test_ranges_keep_every_row_that_reaches_the_bound():
    rng = np.random.default_rng(9)
    x = np.floor(256 * rng.normal(size=(500, 12)) ** 3)  # a few large coordinates each
    rows, anchors, verified = hn.Rows(x, 64), hn.Anchors(np.floor(256 * rng.normal(size=(30, 12)) ** 3), 4), 0
    for i in range(30):
        scores = x @ anchors.q[i]
        needed = float(np.sort(scores)[-10])
        found = []
        for bucket in rows.buckets:
            places, made = anchors.reach(i, bucket, needed, True)
            assert (made == scores[bucket.rows[places]]).all()
            verified += len(places)
            found += bucket.rows[places][made >= needed].tolist()
        assert set(found) == set(np.flatnonzero(scores >= needed).tolist())
    assert verified < 0.5 * 30 * 500
    assert rows.buckets[0].shortest >= rows.buckets[-1].longest


def test_blocks_of_falling_length():
    start, parts, longest = hn.length_blocks({-1: 3, 16: 5, 17: 4, 40: 25, 41: 2}, 10)
    assert (start, parts) == ({41: 0, 40: 1, 17: 4, 16: 4, -1: 5}, {41: 1, 40: 3, 17: 1, 16: 1, -1: 1})
    assert list(longest) == sorted(longest, reverse=True) and longest[0] == 2 ** (42 / 16) and longest[-1] == 0


def test_query_equals_sql(spark):
    df = QUERIES["op11_hard_negatives"](spark, SMALL)
    cur = connect(SMALL).execute(SQL["op11_hard_negatives"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
