"""Exact top-k search by a Voronoi join: pivots, groups, distance bounds from summaries, needed data only.

Vectors become integers, floor(scale * x). Pivots are fitted on a bounded sample (`pivot_sample` rows with the smallest
hash). Every vector belongs to the cell of its nearest pivot. Summaries hold, for each cell and ring (distance to the
pivot in steps of a quarter power of two), how many vectors there are and the largest distance; for query cells also the
largest query length. With p the pivot of a query cell of radius r, and c the pivot of a data cell, the inner product of
a query q with a vector x at distance d from c lies within

    p.c - r |c| - |q| d   and   p.c + r |c| + |q| d .

Adding up counts from the best lower bounds gives, for each query cell, a score that at least k vectors reach besides
all rows that may share the query's id; a ring
whose upper bound is below it cannot hold an answer. Vectors of the remaining rings are sent to the query groups that need
them. Small query cells share a group, large ones are dealt to chunks, the data of a group to blocks; each (group, chunk,
block) is solved by matrix products, and the best k of all blocks are merged. Sample and sizes change the work, never the
answer.

Defined cases: vectors that are null, empty of values, or hold null or non-finite components take no part; shorter vectors
count as if zeros followed; equal scores go to the smaller id; the query's own row (by id) is no candidate; fewer than k
candidates are all returned; ids may repeat: each row is a candidate of other ids, and each query row has ranks of its
own; rows without an id take no part. Scaled components are whole doubles of any size; products that could leave 64 bits
are computed exactly, and an answer whose score leaves them raises an error, as does a finite component that is no longer
finite after scaling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packwise.llm.tables import smallest, staged, tidied

_RINGS = 64


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v): vectors that take part, as integers."""
    given = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), given.alias("w")).where(F.col("w").isNotNull() & F.col("id").isNotNull())

    def whole(x: Column) -> Column:  # doubles from 2^53 on are whole already
        y = x * scale
        large = F.when(F.abs(y) < float("inf"), y).otherwise(F.raise_error(F.lit("a scaled component leaves the doubles")).cast("double"))
        return F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(large)

    return rows.where(good).select("id", F.transform("w", whole).alias("v"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a float matrix, zeros after short rows."""
    sizes = np.asarray(lists.value_lengths())
    values = np.asarray(lists.flatten()).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 6) -> np.ndarray:
    """Cell centres: a few rounds of Lloyd's method from the distinct rows of the sample."""
    rows = np.unique(sample, axis=0)
    rng = np.random.default_rng(9)
    centres = rows[rng.permutation(len(rows))[:pivots]]
    for _ in range(rounds):
        cell = nearest(rows, centres)[0]
        for k in range(len(centres)):
            if (cell == k).any():
                centres[k] = rows[cell == k].mean(0)
    return centres


def nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row (ties: the first) and the distance to it."""
    square = (pivots**2).sum(1)
    cell = np.empty(len(rows), np.int64)
    for low in range(0, len(rows), 4096):
        cell[low : low + 4096] = (square - 2 * rows[low : low + 4096] @ pivots.T).argmin(1)
    return cell, np.linalg.norm(rows - pivots[cell], axis=1)


def ring_of(distance: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(4 * np.log2(np.maximum(distance, 1))), 0, _RINGS * 4).astype(np.int64)


@dataclass
class Plan:
    """needs[(cell, ring)]: query groups that must see it; chunks and blocks of each group; group of each query cell."""

    needs: dict[tuple[int, int], np.ndarray]
    group: np.ndarray
    chunks: np.ndarray
    blocks: np.ndarray


def plan_groups(pivots: np.ndarray, data: list, queries: list, k: int, chunk: int, block: int, own: dict[int, int] | None = None) -> Plan:
    """data: rows (cell, ring, n, far) and queries: rows (cell, n, far, length), one for each cell (and ring).
    own: by query cell, the most rows that share the id of one of its queries (1 where missing)."""
    length = np.linalg.norm(pivots, axis=1)
    cell = np.array([r.cell for r in data], np.int64)
    n, far = np.array([r.n for r in data], np.int64), np.array([r.far for r in data])
    group = np.full(len(pivots), -1)
    chunks: list[int] = []
    filled = 0
    for q in sorted(queries, key=lambda r: r.cell):  # small neighbouring cells share a group
        if not chunks or filled + q.n > chunk:
            chunks.append(0)
            filled = 0
        group[q.cell] = len(chunks) - 1
        filled += q.n
        chunks[-1] = max(1, -(-filled // chunk))
    needed = np.zeros((len(chunks), len(data)), bool)
    for q in queries:
        middle = pivots[q.cell] @ pivots[cell].T
        slack = q.far * length[cell] + q.length * far
        # distances and products are rounded: keep a margin far above that error
        slack = slack * (1 + 1e-6) + 1e-6 * np.abs(middle) + 1e-9 * length[q.cell] * length[cell] + 1e-3
        low, high = middle - slack, middle + slack
        order = np.argsort(-low)
        reached = np.searchsorted(np.cumsum(n[order]), k + (own or {}).get(int(q.cell), 1))
        least = low[order][reached] if reached < len(order) else -np.inf
        needed[group[q.cell]] |= ~(high < least)  # bounds that are no numbers prune nothing
    blocks = np.maximum(1, -(-(needed @ n) // block)) if len(chunks) else np.zeros(0, np.int64)
    needs = {(int(r.cell), int(r.ring)): np.flatnonzero(needed[:, i]) for i, r in enumerate(data)}
    return Plan(needs, group, np.array(chunks, np.int64), blocks)


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of the k best rows for each query, without the rows of the query's id."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1])
    if not top < 2.0**63:  # whole numbers without a greatest size
        whole = np.frompyfunc(int, 1, 1)
        scores = whole(q).dot(whole(x).T)
    elif top < 2.0**53:  # every partial sum is exact in doubles
        scores = (q @ x.T).astype(np.int64)
    else:
        scores = q.astype(np.int64) @ x.astype(np.int64).T
    order = np.argsort(ids, kind="stable")
    exact = scores.dtype == object
    ids, scores = ids[order], scores[:, order]
    out = [], [], []
    for i, own in enumerate(q_ids.tolist()):
        s = scores[i]
        ok = np.flatnonzero(ids != own)
        if len(ok) > k and not exact:
            edge = np.partition(s[ok], len(ok) - k)[len(ok) - k]
            ok = ok[s[ok] >= edge]
        ok = ok[sorted(range(len(ok)), key=lambda j, s=s, ok=ok: (-s[ok[j]], ids[ok[j]]))] if exact else ok[np.lexsort((ids[ok], -s[ok]))]
        ok = ok[:k]
        if exact and any(not -(2**63) <= v < 2**63 for v in s[ok]):
            raise OverflowError("inner products leave 64 bits")
        out[0].append(np.full(len(ok), i))
        out[1].append(ids[ok])
        out[2].append(s[ok].astype(np.int64))
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in out)


def top_k(
    vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, pivots: int = 64,
    pivot_sample: int = 4096, chunk: int = 1024, block: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k pairs of highest integer inner product for each query row. is_query is an
    expression over `id`."""
    rows = staged(integer_vectors(vectors, vec_id, vector, scale))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample = smallest(rows, [F.xxhash64("id", "v"), "id"], pivot_sample).select("v").collect() if dims else []
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    centres = fit_pivots(matrix(pa.array([r.v for r in sample], pa.list_(pa.float64())), dims), pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims)
            cell, far = nearest(x, centres)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell), pa.array(far), pa.array(ring_of(far)), pa.array(np.linalg.norm(x, axis=1))],
                names=["id", "v", "query", "uid", "cell", "far", "ring", "length"],
            )

    placed = rows.withColumn("query", is_query).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        tidied(assign), "id bigint, v array<double>, query boolean, uid bigint, cell bigint, far double, ring bigint, length double"
    )
    placed = staged(placed)
    data = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    asked = placed.where("query").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("length").alias("length")).collect()
    repeated = placed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    own = placed.where("query").join(repeated, "id").groupBy("cell").agg(F.max("n").alias("n")).collect()
    plan = plan_groups(centres, data, asked, k, chunk, block, {r.cell: r.n for r in own})
    needs, group, chunks, blocks = plan.needs, plan.group, plan.chunks, plan.blocks
    if not len(chunks):
        return vectors.sparkSession.createDataFrame([], schema)

    def deal(as_query: bool):
        """Each query to all blocks of its group; each vector, into its block, to all chunks of the groups that need it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, g, c, s = [], [], [], []
                ids = np.asarray(b.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                cells, rings = b.column(2).to_pylist(), b.column(3).to_pylist()
                for i, (own, cell, ring) in enumerate(zip((ids >> np.uint64(20)).tolist(), cells, rings, strict=True)):
                    for at in (int(group[cell]),) if as_query else needs[cell, ring].tolist():
                        fixed = own % int(chunks[at] if as_query else blocks[at])
                        for free in range(int(blocks[at] if as_query else chunks[at])):
                            row.append(i)
                            g.append(at)
                            c.append(fixed if as_query else free)
                            s.append(free if as_query else fixed)
                taken = b.select(["id", "v", "uid"]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64()), *taken.columns], names=["g", "c", "s", "id", "v", "uid"]
                )

        return run

    dealt = "g bigint, c bigint, s bigint, id bigint, v array<double>, uid bigint"
    asked_rows = placed.where("query").select("id", "v", "cell", "ring", "uid").mapInArrow(tidied(deal(True)), dealt)
    data_rows = placed.select("id", "v", "cell", "ring", "uid").mapInArrow(tidied(deal(False)), dealt)

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        def dense(v: pd.Series) -> np.ndarray:
            return matrix(pa.array(list(v), pa.list_(pa.float64())), dims)

        found = best_of(q["id"].to_numpy(), dense(q["v"]), x["id"].to_numpy(), dense(x["v"]), k) if len(q) and len(x) else [np.empty(0, np.int64)] * 3
        uid, query_id = q["uid"].to_numpy(np.int64)[found[0]], q["id"].to_numpy(np.int64)[found[0]]
        return pd.DataFrame({"uid": uid, "query_id": query_id, "vec_id": found[1], "score": found[2]})

    keys = ("g", "c", "s")
    parts = asked_rows.groupBy(*keys).cogroup(data_rows.groupBy(*keys)).applyInPandas(solve, "uid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
