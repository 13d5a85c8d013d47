import math

import numpy as np
from pyspark.sql import functions as F

from packwise.llm import voronoi_knn
from packwise.llm.queries import QUERIES, SQL


def _brute(rows, k, asked, scale=1024):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in ok if asked(i)}:
        best = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_query_equals_sql(spark):
    from checks.compare import connect, rows_of

    folder = "/root/testdata/sf0.01"
    df = QUERIES["op1_voronoi_knn"](spark, folder)
    cur = connect(folder).execute(SQL["op1_voronoi_knn"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_clusters_are_pruned_and_answers_stay_exact(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 6)) * 5
    vectors = [(centres[i % 8] + rng.standard_normal(6) * 0.05).tolist() for i in range(400)] + [[0.5] * 6] * 120
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    for options in ({}, {"pivots": 8, "chunk": 3, "block": 16}, {"pivots": 1}):
        got = voronoi_knn.top_k(frame, F.col("id") % 10 == 0, k=5, **options).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == _brute(rows, 5, lambda i: i % 10 == 0)
        assert len(got) == 5 * 52
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float))
    pivots = voronoi_knn.fit_pivots(x, 9)
    cell, far = voronoi_knn.nearest(x, pivots)
    data = [_Row(cell=c, ring=0, n=int((cell == c).sum()), far=far[cell == c].max()) for c in range(len(pivots)) if (cell == c).any()]
    asked = [_Row(cell=0, n=1, far=0.0, length=float(np.linalg.norm(pivots[0])))]
    assert len([v for v in voronoi_knn.plan_groups(pivots, data, asked, 5, 10, 10).needs.values() if len(v)]) < len(data)


class _Row:
    def __init__(self, **values):
        self.__dict__.update(values)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [3.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (100, [-1.0, 0.5])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = voronoi_knn.top_k(frame, F.col("id") % 100 == 0).collect()
    byq = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
    assert [x[2] for x in byq if x[0] == 0] == [7, 7, 6, 5, 100]
    assert [x[2] for x in byq if x[0] == 100] == [0, 5, 7, 7, 6]
    assert voronoi_knn.top_k(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    assert voronoi_knn.top_k(frame.where("vec_id = 5"), F.col("id") % 100 == 0).count() == 0


def test_rows_with_the_own_id_and_large_vectors(spark):
    # the query's own id fills the best ring: rings with its answers must not be pruned
    near = [(0, [100.0, 0.0])] * 8 + [(i, [100.0 - 3 * i, 1.0]) for i in range(1, 12)]
    far = [(i, [-100.0, float(i)]) for i in range(20, 40)]
    cells = [_Row(cell=0, ring=0, n=8, far=0.0), _Row(cell=1, ring=0, n=3, far=0.1)]
    asked = [_Row(cell=0, n=8, far=0.0, length=100.0)]
    plan = voronoi_knn.plan_groups(np.array([[100.0, 0.0], [50.0, 0.0]]), cells, asked, 3, 10, 10, {0: 8})
    assert all(len(v) for v in plan.needs.values())
    large = [(50, [3e9, 0.0]), (51, [-3e9, 5.0]), (52, [8e10, -1.0])]
    frame = spark.createDataFrame(near + far + large, "vec_id long, embedding array<double>")
    got = voronoi_knn.top_k(frame, F.col("id") == 1, k=5, pivots=8).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.vec_id} == {
        x for x in _brute(near + far + large, 5, lambda i: i == 1) if x[2]
    }
    assert {52, 50} <= {r.vec_id for r in got}
    got = sorted((r["rank"], r.vec_id) for r in voronoi_knn.top_k(frame, F.col("id") == 0, k=3, pivots=8, scale=1).collect())
    assert got == [(rank, vec) for rank, vec in ((1, 52), (2, 50), (3, 1)) for _ in range(8)]  # each of the eight rows has its answers
    small = spark.createDataFrame(near + far, "vec_id long, embedding array<double>")
    got = voronoi_knn.top_k(small.where("vec_id <> 0").union(small.where("vec_id = 0").limit(1)), F.col("id") == 0, k=3, pivots=8).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3]
