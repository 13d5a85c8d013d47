"""Hard negatives by coordinate pruning of an exact inner-product search.

For each anchor row: its positives, the best rows of the same label; then for each positive the best rows of other labels
whose score lies between low and high hundredths of the positive's score.

**Pruning.** Rows of a task are ordered by length and cut into length buckets. A bucket holds, for each coordinate, the list of
its rows' values on the unit sphere in order. An anchor q that needs a score of at least s from vectors of lengths up to l needs a cosine of
t = s / (|q| l). With a the angle of t and b the angle of coordinate f of q, the coordinate f of every vector that can reach t
lies within cos(b + a) and cos(b - a) (cut at 0 and 180 degrees). The anchor's focus coordinates are those where its own values
are largest; the narrowest of their feasible ranges is read from its sorted list, the others intersect it, and what is left is
verified exactly. A bucket that cannot reach t at all is skipped. What is needed rises with every bucket: positives start
without a bound, negatives with the least of low * score / 100; the k-th best so far takes over.

**Distribution.** Positives: rows of a label are dealt to parts of at most `block` rows (small labels share groups), anchors
of the label go to all its parts, in chunks. Negatives: blocks of rows of similar length, from counts by length class; an
anchor goes to the blocks that are long enough for it, which are a prefix of the blocks by falling length. Each task keeps k
rows for each anchor (and positive), and those are merged. Sizes of blocks change the work, never the answer; each
(block, chunk) is bounded, so that no label, length or repeated vector fills one task.

Defined cases: rows with a null id or label or with a vector that is null, empty or holds null or non-finite components (also after scaling) take
no part; shorter vectors count as if zeros followed; ids may repeat: each row is an anchor, positive or negative of its own, and
of equal scores and ids any order holds; a row is no positive of itself; positives of one anchor with equal scores have
the same negatives; a negative score of a positive allows no negatives, since the range is empty; a score beyond 64
bits counts as the nearest 64-bit number; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packwise.llm.tables import staged, tidied, whole_vector
from packwise.llm.voronoi_knn import matrix

_MARGIN = 1e-7  # far above rounding errors of cosines
_CLASSES = 16  # length classes for each power of two
_LEAST, _MOST = -(2**63), 2**63 - 1


class Bucket:
    """Rows of similar length with their coordinate lists, which are sorted when first asked for."""

    def __init__(self, x: np.ndarray, length: np.ndarray, rows: np.ndarray):
        self.rows, self.x = rows, x[rows]
        own = length[rows]
        self.shortest, self.longest = float(own.min()), float(own.max())
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            self.unit = self.x / own[:, None]
        self.plain = bool(np.isfinite(self.unit).all())  # rows without a direction are never pruned
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, length: float, needed: float) -> np.ndarray | None:
        """Rows that may score `needed` or more with an anchor of this direction and length; None stands for all."""
        if not self.plain or not np.isfinite(needed):
            return None
        with np.errstate(invalid="ignore", over="ignore"):
            cosine = needed / (np.float64(length) * (self.longest if needed > 0 else self.shortest))
        if not cosine > -1:
            return None
        if cosine > 1 + _MARGIN:
            return np.empty(0, np.int64)
        wide, own = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(own + wide, np.pi)) - _MARGIN
        high = np.cos(np.maximum(own - wide, 0)) + _MARGIN
        ends = []
        for f, a, b in zip(focus.tolist(), low, high, strict=True):
            values = self.sorted_list(f)[1]
            ends.append((int(np.searchsorted(values, a)), int(np.searchsorted(values, b, "right"))))
        sizes = [e - s for s, e in ends]
        best = int(np.argmin(sizes))
        if 2 * sizes[best] > len(self.rows):
            found = np.flatnonzero((self.unit[:, focus[best]] >= low[best]) & (self.unit[:, focus[best]] <= high[best]))
        else:
            found = self.sorted_list(int(focus[best]))[0][slice(*ends[best])]
        for k, f in enumerate(focus.tolist()):
            if k != best and len(found):
                values = self.unit[found, f]
                found = found[(values >= low[k]) & (values <= high[k])]
        return found


class Rows:
    """Rows of one task in length buckets, longest first."""

    def __init__(self, x: np.ndarray, bucket: int):
        self.x = x
        with np.errstate(over="ignore"):
            self.length = np.sqrt((x * x).sum(1))
        order = np.argsort(-self.length, kind="stable")
        self.buckets = [Bucket(x, self.length, order[i : i + bucket]) for i in range(0, len(order), bucket)]
        self.top = float(np.abs(x).max(initial=0))


class Anchors:
    def __init__(self, q: np.ndarray, focus: int):
        self.q = q
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            self.length = np.sqrt((q * q).sum(1))
            self.unit = q / self.length[:, None]
        self.focus = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :focus]
        self.top = float(np.abs(q).max(initial=0))

    def reach(self, i: int, bucket: Bucket, needed: float, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places in the bucket that may reach `needed`, and their scores."""
        if needed > _LEAST and np.isfinite(self.unit[i]).all():
            found = bucket.candidates(self.unit[i], self.focus[i], float(self.length[i]), needed)
        else:
            found = None
        x = bucket.x if found is None else bucket.x[found]
        found = np.arange(len(bucket.rows)) if found is None else found
        if exact:
            return found, x @ self.q[i]
        whole = np.frompyfunc(int, 1, 1)
        return found, np.clip(whole(x).dot(whole(self.q[i])), _LEAST, _MOST) if len(x) else np.empty(0, object)


def _in_doubles(anchors: Anchors, rows: Rows) -> bool:
    """Whether scores, times 100, are exact in doubles."""
    return anchors.top * rows.top * max(1, rows.x.shape[1]) * 100 < 2.0**53


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_rows(anchors: Anchors, own: np.ndarray, rows: Rows, uids: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): the k best rows of each anchor, without the row that it is itself."""
    exact = _in_doubles(anchors, rows)
    for i in range(len(anchors.q)):
        places, scores = np.empty(0, np.int64), np.empty(0, float if exact else object)
        for bucket in rows.buckets:
            needed = float(scores[-1]) if len(scores) == k else -np.inf
            found, made = anchors.reach(i, bucket, needed, exact)
            found = bucket.rows[found]
            good = (made >= needed) & (uids[found] != own[i])
            places, scores = np.concatenate([places, found[good]]), np.concatenate([scores, made[good]])
            first = _first(scores, ids[places], k)
            places, scores = places[first], scores[first]
        yield i, places, scores


def best_below(
    anchors: Anchors, labels: np.ndarray, positives: list[list[int]], rows: Rows, row_labels: np.ndarray, ids: np.ndarray, k: int, low: int, high: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, positive's score, rows, scores): the k best rows of other labels within low and high hundredths of each
    distinct positive's score."""
    exact = _in_doubles(anchors, rows)
    for i in range(len(anchors.q)):
        wanted = [p for p in dict.fromkeys(positives[i]) if low * p <= high * p]
        held = {p: (np.empty(0, np.int64), np.empty(0, float if exact else object)) for p in wanted}

        def least(p: int, held=held) -> float:  # in hundredths
            full = len(held[p][0]) == k
            return max(low * p, 100 * held[p][1][-1]) if full else low * p

        for bucket in rows.buckets if wanted else ():
            needed = min(least(p) for p in wanted)
            found, made = anchors.reach(i, bucket, float(needed) / 100, exact)
            good = (100 * made >= needed) & (row_labels[bucket.rows[found]] != labels[i])
            found, made = bucket.rows[found[good]], made[good]
            if not len(found):
                continue
            for p in wanted:
                fits = (100 * made >= least(p)) & (100 * made <= high * p)
                if fits.any():
                    places, scores = np.concatenate([held[p][0], found[fits]]), np.concatenate([held[p][1], made[fits]])
                    first = _first(scores, ids[places], k)
                    held[p] = places[first], scores[first]
        for p, (places, scores) in held.items():
            yield i, p, places, scores


def length_blocks(counts: dict[int, int], block: int) -> tuple[dict[int, int], dict[int, int], np.ndarray]:
    """First block and number of blocks of each length class, and the greatest length of each block, falling. A class above
    `block` rows has blocks of its own, smaller neighbouring classes share one."""
    start: dict[int, int] = {}
    parts: dict[int, int] = {}
    longest: list[float] = []
    room = 0
    for c in sorted(counts, reverse=True):
        n, top = counts[c], 0.0 if c < 0 else 2.0 ** min((c + 1) / _CLASSES, 1023)
        if n > room:
            parts[c] = max(1, -(-n // block))
            start[c] = len(longest)
            longest += [top if c < _CLASSES * 1023 else np.inf] * parts[c]
            room = block - n if n < block else 0
        else:
            start[c], parts[c], room = len(longest) - 1, 1, room - n
    return start, parts, np.array(longest)


def _dense(v: pd.Series, dims: int) -> np.ndarray:
    return matrix(pa.array(list(v), pa.list_(pa.float64())), dims)


def mined(
    vectors: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, block: int = 1 << 17, chunk: int = 1 << 15, least_block: int = 2048,
    least_chunk: int = 1024, focus: int = 4, bucket: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor is an expression over `id`."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), whole_vector(vector, scale).alias("v"))
    given = given.where("id is not null and label is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    given = given.withColumn("class", F.when(norm > 0, F.least(F.floor(F.log2(norm) * _CLASSES), F.lit(1 << 20))).otherwise(-1).cast("long"))
    if dict(vectors.dtypes)[label] not in ("tinyint", "smallint", "int", "bigint"):  # tasks see numbers
        given = given.withColumn("label", F.xxhash64(F.col("label").cast("string")))
    given = given.withColumn("label", F.col("label").cast("long"))
    rows = staged(given.select(F.monotonically_increasing_id().alias("uid"), "*").withColumn("anchor", F.coalesce(is_anchor, F.lit(False))))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not facts.anchors:
        return spark.createDataFrame([], schema)
    dims = facts.dims
    # enough tasks for small tables, bounded ones for large
    block = min(block, max(least_block, facts.n // 64))
    chunk = min(chunk, max(least_chunk, facts.anchors // 8))

    # positives: parts of each label; labels below a quarter of a block share groups
    groups = max(1, 2 * facts.n // block)
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("asked"))
    large = F.col("n") * 4 >= block
    sizes = counts.where("asked > 0").select(
        "label",
        F.when(large, F.concat(F.lit("label "), F.col("label"))).otherwise(F.concat(F.lit("group "), F.pmod(F.xxhash64("label"), F.lit(groups)))).alias("g"),
        F.ceil(F.col("n") / block).cast("int").alias("parts"),
        F.ceil(F.col("asked") / chunk).cast("int").alias("chunks"),
    )
    here = rows.join(sizes, "label")
    own_part, own_chunk = F.pmod(F.xxhash64("uid"), "parts").cast("int"), F.pmod(F.xxhash64("uid", F.lit(1)), "chunks").cast("int")
    every_part, every_chunk = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "chunks"))
    asked = here.where("anchor").select("g", every_part.alias("part"), own_chunk.alias("chunk"), "uid", "label", "v").toDF("g", "part", "chunk", "uid", "label", "v")
    data = here.select("g", own_part.alias("part"), every_chunk.alias("chunk"), "uid", "id", "label", "v")

    def find(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple] = []
        mine = {k: v for k, v in x.groupby("label")} if len(q) else {}
        for value, some in q.groupby("label"):
            if value not in mine:
                continue
            have = mine[value]
            uids, ids = have["uid"].to_numpy(), have["id"].to_numpy()
            anchors, own = Anchors(_dense(some["v"], dims), focus), some["uid"].to_numpy()
            for i, places, scores in best_rows(anchors, own, Rows(_dense(have["v"], dims), bucket), uids, ids, positives):
                made += zip([int(own[i])] * len(places), uids[places].tolist(), ids[places].tolist(), map(int, scores), strict=True)
        return pd.DataFrame(made, columns=["uid", "positive_uid", "positive_id", "positive_score"]).astype("int64")

    keys = ("g", "part", "chunk")
    pairs = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(find, "uid long, positive_uid long, positive_id long, positive_score long")
    best = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "positive_uid")
    pairs = staged(pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives))

    # negatives: blocks of falling length, each of whole length classes or a part of one
    classes = rows.groupBy("class").agg(F.count("*").alias("n")).collect()  # bounded by the range of doubles
    start, parts, longest = length_blocks({r["class"]: r.n for r in classes}, block)
    chunks = max(1, -(-facts.anchors // chunk))

    scores = pairs.groupBy("uid").agg(F.collect_set("positive_score").alias("scores"))  # at most `positives` numbers
    asked = rows.where("anchor").join(scores, "uid").select("uid", "label", "v", "scores")
    asked_schema = "block int, chunk int, uid bigint, label bigint, v array<double>, scores array<bigint>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor to the blocks that are long enough for it."""
        for b in batches:
            length = np.linalg.norm(matrix(b.column(2), dims), axis=1)
            needed = np.array([low * min((s for s in own if s >= 0), default=np.inf) / 100 for own in b.column(3).to_pylist()])
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                far = needed / length * (1 - 1e-6)
            far = np.where(np.isnan(far), 0, far)  # a zero anchor with a zero score: all blocks
            count = np.where(np.isinf(needed), 0, np.searchsorted(-longest, -far, "right"))
            row = np.repeat(np.arange(b.num_rows), count)
            to = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            mixed = np.asarray(b.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            own_chunk = ((mixed >> np.uint64(20)) % np.uint64(chunks)).astype(np.int32)
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), pa.array(own_chunk[row]), *taken.columns], names=["block", "chunk", "uid", "label", "v", "scores"]
            )

    placed = spark.createDataFrame([(c, start[c], parts[c]) for c in start], "class long, start int, parts int")
    data = rows.join(F.broadcast(placed), "class").select(
        (F.col("start") + F.pmod(F.xxhash64("uid"), F.col("parts"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        "uid", "id", "label", "v",
    )

    def mine(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple] = []
        if len(q) and len(x):
            ids, uids, own = x["id"].to_numpy(), x["uid"].to_numpy(), q["uid"].to_numpy()
            wanted = [[int(s) for s in scores] for scores in q["scores"]]
            held = Rows(_dense(x["v"], dims), bucket)
            found = best_below(Anchors(_dense(q["v"], dims), focus), q["label"].to_numpy(), wanted, held, x["label"].to_numpy(), ids, negatives, low, high)
            for i, p, places, scores in found:
                made += zip([int(own[i])] * len(places), [p] * len(places), uids[places].tolist(), ids[places].tolist(), map(int, scores), strict=True)
        return pd.DataFrame(made, columns=["uid", "positive_score", "negative_uid", "negative_id", "negative_score"]).astype("int64")

    keys = ("block", "chunk")
    below = asked.mapInArrow(tidied(deal), asked_schema).groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(
        mine, "uid long, positive_score long, negative_uid long, negative_id long, negative_score long"
    )
    best = Window.partitionBy("uid", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_uid")
    below = below.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = pairs.join(rows.where("anchor").select("uid", F.col("id").alias("anchor_id")), "uid")
    return named.join(below, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
