"""Restaurants of previous words for `pitman_yor`: every pair of a word and the word before it, of all texts.

Pairs are dealt into buckets. A pair whose previous word is no symbol lies in the bucket of that word, with its whole restaurant; the
restaurants of symbols (the most frequent words and the end) are spread by the second word, and their sums over buckets come to
the driver. Inside a bucket words are codes: the place on the list of known words, one more for the end, and above that
the bucket's other words. What is exchanged are packed arrays, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwise.llm.seating import drawn_tables
from packwise.llm.tables import give_back, rows_of, staged, texts_of, tidied
from packwise.llm.words import NOT_BLANK, mix, words_of

CODE, COUNT, KEY, LAST = np.dtype("<u4"), np.dtype("<i8"), np.dtype("<u8"), np.dtype("u1")
END_KEY = np.uint64(0x5851F42D4C957F2D)
BATCH_BYTES = 3 << 20  # of texts whose tokens are arrays at a time
_SIDE = np.uint64(0xD1342543DE82EF95)


def learnt(held_out: Column) -> Column:
    return F.coalesce(~held_out, F.lit(False))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed text; numbers by bytes of equal weight, which compress better, keys and floats as they are."""
    raw = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    raw += b"".join(a.view("u1").reshape(-1, a.itemsize).T.tobytes() if a.dtype in (CODE, COUNT) else a.tobytes() for a in arrays)
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *types: np.dtype) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(blob)[8:], int(np.frombuffer(blob, "<i8", 1)[0]), codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(raw, "<i8", len(types))) + 8 * len(types)
    out, start = [], 8 * len(types)
    for t, end in zip(types, ends.tolist(), strict=True):
        if t in (CODE, COUNT):
            planes = np.frombuffer(raw, "u1", end - start, start).reshape(t.itemsize, -1)
            out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        else:
            out.append(np.frombuffer(raw, t, (end - start) // t.itemsize, start))
        start = end
    return out


def steps(sorted_codes: np.ndarray) -> np.ndarray:
    """Differences, whose cumulative sum gives ascending codes back."""
    return np.diff(sorted_codes, prepend=sorted_codes.dtype.type(0))


@dataclass
class Tokens:
    """All tokens of a batch, each text's end after its words, with the token before each (a text starts after an end)."""

    code: np.ndarray  # on the list, or the end; others: one above the end
    key: np.ndarray
    symbol: np.ndarray
    text: np.ndarray

    def before(self, of: str, first) -> np.ndarray:
        line = getattr(self, of)
        return np.concatenate([np.array([first], line.dtype), line[:-1]])


def tokens_of(words, lists, at: np.ndarray, symbol: np.ndarray) -> Tokens:
    n, end = words.counts(), len(lists.keys)
    ends = np.cumsum(n + 1) - 1
    inside = np.ones(len(symbol) + len(n), bool)
    inside[ends] = False

    def line(of_end, of_words):
        out = np.full(len(inside), of_end, of_words.dtype)
        out[inside] = of_words
        return out

    return Tokens(
        line(end, np.where(at >= 0, at, end + 1)), line(END_KEY, words.hashes), line(lists.symbols, symbol), np.repeat(np.arange(len(n)), n + 1)
    )


def _buckets_of(tokens: Tokens, lists, buckets: int) -> np.ndarray:
    spread = tokens.before("symbol", lists.symbols) <= lists.symbols
    return (mix(np.where(spread, tokens.key, tokens.before("key", END_KEY)) ^ _SIDE) % np.uint64(buckets)).astype(np.int64)


def _dealt(tokens: Tokens, lists, buckets: int, chosen: np.ndarray, value: np.ndarray, add: bool) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pairs) of the chosen tokens. value: a number of each token; with `add` equal pairs are one, with its sum."""
    end = len(lists.keys)
    code, off = tokens.code.copy(), tokens.code > end
    other, place = np.unique(tokens.key[off], return_inverse=True)
    code[off] = end + 1 + place
    u = np.concatenate([[end], code[:-1]])
    width = end + 1 + len(other)
    bucket = _buckets_of(tokens, lists, buckets)
    number = ((bucket * width + u) * width + code)[chosen]
    del u, code, off
    order = np.argsort(number)
    number, value = number[order], value[chosen][order]
    if add:
        first = np.flatnonzero(np.diff(number, prepend=-1))
        value = np.add.reduceat(value, first) if len(first) else value
        number, order = number[first], order[first]
    last = (tokens.symbol - lists.symbols - 1)[chosen][order]
    last_u = (tokens.before("symbol", lists.symbols) - lists.symbols - 1)[chosen][order]
    bucket, w = number // (width * width), number % width
    u = number // width % width
    of_u, of_w = u > end, w > end
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    stops = np.append(starts, len(bucket))[1:]
    key_u, key_w = other[u[of_u] - end - 1], other[w[of_w] - end - 1]
    last_u, last_w = last_u[of_u].astype(LAST), last[of_w].astype(LAST)
    at_u, at_w = np.concatenate([[0], np.cumsum(of_u)]), np.concatenate([[0], np.cumsum(of_w)])
    u, w = np.minimum(u, end + 1).astype(CODE), np.minimum(w, end + 1).astype(CODE)
    for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
        us, ws = slice(at_u[s], at_u[e]), slice(at_w[s], at_w[e])
        yield int(bucket[s]), pack(steps(u[s:e]), w[s:e], value[s:e].astype(COUNT), key_u[us], key_w[ws], last_u[us], last_w[ws])


@dataclass
class Bucket:
    """Pairs of one bucket, sorted by the codes of both words. other, last: keys and last bytes of words that are not on the list."""

    u: np.ndarray
    w: np.ndarray
    n: np.ndarray
    other: np.ndarray
    last: np.ndarray

    def packed(self) -> bytes:
        return pack(steps(self.u.astype(CODE)), self.w.astype(CODE), self.n.astype(COUNT), self.other.astype(KEY), self.last.astype(LAST))

    @staticmethod
    def unpacked(blob: bytes) -> Bucket:
        u, w, n, other, last = unpack(blob, CODE, CODE, COUNT, KEY, LAST)
        return Bucket(np.cumsum(u, dtype=np.int64), w.astype(np.int64), n, other, last)


def _gathered(blobs: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes of both words of all rows in the packed pairs, the values of each blob, and the other words."""
    parts = [unpack(b, CODE, CODE, COUNT, KEY, KEY, LAST, LAST) for b in blobs]
    u = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts])
    w = np.concatenate([p[1] for p in parts]).astype(np.int64)
    key_u, key_w, last_u, last_w = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))
    other, first, code = np.unique(np.concatenate([key_u, key_w]), return_index=True, return_inverse=True)
    last = np.concatenate([last_u, last_w])[first]
    u[u > end] = end + 1 + code[: len(key_u)]
    w[w > end] = end + 1 + code[len(key_u) :]
    return u, w, [p[2] for p in parts], other, last


def _released(function):
    """A function for applyInArrow that gives freed memory back."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            give_back()

    return run


def pair_counts(docs: DataFrame, held_out: Column, text: str, lists, buckets: int) -> DataFrame:
    """(bucket, pairs): each bucket's pairs with their counts over training texts; pairs of held-out texts alone have 0."""
    end = len(lists.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, BATCH_BYTES):
            words = words_of(texts_of(batch.column(0)), NOT_BLANK)
            tokens = tokens_of(words, lists, *lists.find(words))
            train = batch.column(1).to_numpy(zero_copy_only=False)
            made = list(_dealt(tokens, lists, buckets, np.arange(len(tokens.code)), train[tokens.text].astype(np.int64), True))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([p for _, p in made], pa.binary())], names=["bucket", "pairs"])

    def merge(table: pa.Table) -> pa.Table:
        u, w, values, other, last = _gathered(table.column("pairs").to_pylist(), end)
        width = end + 1 + len(other)
        number = u * width + w
        order = np.argsort(number)
        number, n = number[order], np.concatenate(values)[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        merged = Bucket(number[first] // width, number[first] % width, np.add.reduceat(n, first), other, last)
        return pa.table([table.column("bucket")[:1], pa.array([merged.packed()], pa.binary())], names=["bucket", "pairs"])

    found = docs.select(text, learnt(held_out).alias("learnt")).mapInArrow(tidied(count), "bucket int, pairs binary")
    return found.groupBy("bucket").applyInArrow(_released(merge), "bucket int, pairs binary")


def _over_buckets(pairs: DataFrame, schema: str, start, bucket_rows, end_rows) -> DataFrame:
    """start() makes a task's sums, bucket_rows(sums, number, Bucket) adds a bucket and may give a batch, end_rows(sums) gives the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = start()
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = bucket_rows(sums, number, Bucket.unpacked(blob.as_buffer()))
                if made is not None:
                    yield made
        yield end_rows(sums)

    return pairs.mapInArrow(tidied(run), schema)


def _sums(kinds: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    kind = np.concatenate([np.full(len(k), n, np.int32) for n, k, _ in kinds])
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(np.concatenate([k for _, k, _ in kinds]).astype(np.int64)), pa.array(np.concatenate([v for *_, v in kinds]).astype(np.int64))],
        names=["kind", "key", "n"],
    )


def first_sums(pairs: DataFrame, lists) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Counts of (symbol before, symbol), number of different words after each symbol, and numbers of pairs that occur once and twice."""
    size, end = lists.size, len(lists.keys)

    def start():
        return np.zeros(size * size, np.int64), np.zeros(lists.symbols + 1, np.int64), np.zeros(2, np.int64)

    def add(sums, number, b):
        symbol = np.concatenate([lists.own, [lists.symbols], lists.symbols + 1 + b.last.astype(np.int64)])
        seen = b.n > 0
        u, w, n = symbol[b.u[seen]], symbol[b.w[seen]], b.n[seen]
        sums[0][:] += np.bincount(u * size + w, n, len(sums[0])).astype(np.int64)
        sums[1][:] += np.bincount(u[u <= lists.symbols], minlength=lists.symbols + 1)
        sums[2][:] += [(n == 1).sum(), (n == 2).sum()]

    def finish(sums):
        return _sums([(k, np.flatnonzero(s), s[s > 0]) for k, s in enumerate(sums)])

    out = [np.zeros(size * size, np.int64), np.zeros(lists.symbols + 1, np.int64), np.zeros(2, np.int64)]
    rows = _over_buckets(pairs, "kind int, key bigint, n bigint", start, add, finish).groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (rows.column(c).to_numpy() for c in ("kind", "key", "n"))  # at most size * size and a few
    for k, sums in enumerate(out):
        sums[key[kind == k]] = n[kind == k]
    return out[0].reshape(size, size), out[1], int(out[2][0]), int(out[2][1])


@dataclass
class Parent:
    """What a seating of pairs is drawn under. share: P(symbol | symbol before); rare: weight of each known word in the restaurant of its
    last byte (1 for symbols); customers: of these restaurants; tables: of the restaurants of symbols."""

    lists: object
    share: np.ndarray
    rare: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    discount: float
    samples: int

    def seated(self, b: Bucket) -> np.ndarray:
        """Tables of each pair, (samples, pairs). A pair's random numbers come from its two words."""
        lists, end = self.lists, len(self.lists.keys)
        symbol = np.concatenate([lists.own, [lists.symbols], lists.symbols + 1 + b.last.astype(np.int64)])
        key = np.concatenate([lists.keys, np.array([END_KEY]), b.other.astype(np.uint64)])
        words = np.bincount(b.w, b.n, len(key))
        # words beyond the list weigh by their own count here
        rare = np.concatenate([self.rare, [1.0], (np.maximum(words[end + 1 :], 1) / (1 + self.customers[b.last])) if len(b.last) else []])
        base = self.share[symbol[b.u], symbol[b.w]] * rare[b.w]
        own = symbol[b.u] > lists.symbols
        total, types = np.bincount(b.u, b.n, len(key)), np.bincount(b.u, b.n > 0, len(key))
        tables = np.where(symbol > lists.symbols, np.maximum(types, total**self.discount), 0.0)
        spread = ~own
        weight = tables[b.u]
        weight[spread] = self.tables[symbol[b.u[spread]]]
        with np.errstate(over="ignore"):
            seeds = mix(key[b.u] * np.uint64(0x2545F4914F6CDD1D) + mix(key[b.w]))
            rows = np.stack([mix(seeds + np.uint64(k) * _SIDE) for k in range(self.samples + 1)])
        # a first sweep seats restaurants that lie here whole by their usual number of tables, the next ones by its result
        first = drawn_tables(b.n, (1 + self.discount * weight) * base, self.discount, rows[-1:])[0]
        weight = np.where(own, np.bincount(b.u, first, len(key))[b.u], weight)
        fresh = (1 + self.discount * weight) * base
        return drawn_tables(b.n, fresh, self.discount, rows[:-1])


@dataclass
class Seats:
    """Sums over the drawn tables. words: (key, last, bucket, n, c) of rare words, n tables of one sample, c their count
    (0 for known words), bucket null for known words; symbols: (size, size) tables of one sample; spread: customers and mean tables of restaurants of symbols;
    dense: count and mean tables of pairs of symbols."""

    words: DataFrame
    symbols: np.ndarray
    spread: tuple[np.ndarray, np.ndarray]
    dense: tuple[np.ndarray, np.ndarray]


def seats(pairs: DataFrame, parent: Parent, counts: np.ndarray) -> Seats:
    lists, samples = parent.lists, parent.samples
    size, end, m = lists.size, len(lists.keys), lists.symbols + 1
    names = ["kind", "key", "n", "bucket", "last", "c"]

    def start():
        return np.zeros(size * size, np.int64), np.zeros(end, np.int64), np.zeros(m, np.int64), np.zeros(m * m, np.int64), np.zeros(m * m, np.int64)

    def batch(kind, key, n, bucket, last, c):
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), bucket, pa.array(last, pa.int32()), pa.array(c, pa.int64())],
            names=names,
        )

    def add(sums, number, b):
        drawn = parent.seated(b)
        symbol = np.concatenate([lists.own, [lists.symbols], lists.symbols + 1 + b.last.astype(np.int64)])
        u, w = symbol[b.u], symbol[b.w]
        sums[0][:] += np.bincount(u * size + w, drawn[0], len(sums[0])).astype(np.int64)
        of_word = np.bincount(b.w, drawn[0], end + 1 + len(b.other)).astype(np.int64)
        sums[1][:] += of_word[:end]
        all_tables = drawn.sum(0)
        spread = u < m
        sums[2][:] += np.bincount(u[spread], all_tables[spread], m).astype(np.int64)
        both = spread & (w < m)
        sums[3][:] += np.bincount(u[both] * m + w[both], b.n[both], m * m).astype(np.int64)
        sums[4][:] += np.bincount(u[both] * m + w[both], all_tables[both], m * m).astype(np.int64)
        # one row for each word beyond the list that follows another here: its tables, and a request for its share
        other = np.zeros(len(b.other), bool)
        other[b.w[b.w > end] - end - 1] = True
        k = int(other.sum())
        if k:
            times = np.bincount(b.w, b.n, end + 1 + len(other))[end + 1 :].astype(np.int64)
            return batch(
                np.full(k, 5), b.other[other].view(np.int64), of_word[end + 1 :][other], pa.array(np.full(k, number), pa.int32()),
                b.last[other].astype(np.int32), times[other],
            )

    def finish(sums):
        rare = (lists.symbol < 0) & (sums[1] > 0)
        made = [(k, np.flatnonzero(s), s[s > 0], np.zeros((s > 0).sum())) for k, s in enumerate(sums) if k != 1]
        made.append((1, lists.keys[rare].view(np.int64), sums[1][rare], lists.own[rare] - m))
        kind, key, n, last = (np.concatenate(c) for c in zip(*[(np.full(len(key), k), key, n, last) for k, key, n, last in made], strict=True))
        return batch(kind.astype(np.int32), key, n, pa.nulls(len(key), pa.int32()), last.astype(np.int32), np.zeros(len(key), np.int64))

    schema = "kind int, key bigint, n bigint, bucket int, last int, c bigint"
    made = staged(_over_buckets(pairs, schema, start, add, finish))
    words = made.where(F.col("kind").isin(1, 5)).select("key", "last", "bucket", "n", "c")
    rows = made.where(F.col("kind").isin(0, 2, 3, 4)).groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (rows.column(c).to_numpy() for c in ("kind", "key", "n"))  # at most size * size and a few

    def summed(k, length):
        out = np.zeros(length, np.int64)
        out[key[kind == k]] = n[kind == k]
        return out

    spread = counts[:m].sum(1), summed(2, m) / samples
    dense = summed(3, m * m).reshape(m, m), summed(4, m * m).reshape(m, m) / samples
    return Seats(words, summed(0, size * size).reshape(size, size), spread, dense)


def own_and_new(n, tables, customers, all_tables, discount) -> tuple[np.ndarray, np.ndarray]:
    """A dish's own share, and the weight of its share in the parent."""
    return (n - discount * tables) / (1 + customers), (1 + discount * all_tables) / (1 + customers)


SHARE = (KEY, np.dtype("<f8"), COUNT)


def packed_shares(shares: DataFrame, most: int = 500_000) -> DataFrame:
    """(bucket, pairs): the keys, log_p and c of each bucket, packed by each task for about `most` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            waiting, rows = [*waiting, batch], rows + batch.num_rows
            if rows >= most:
                yield made(waiting)
                waiting, rows = [], 0
        if rows:
            yield made(waiting)

    def made(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        bucket, key, log_p, c = (x.to_numpy() for x in pa.Table.from_batches(batches).columns)
        order = np.lexsort((key, bucket))
        bucket, columns = bucket[order], [key[order].view(np.uint64), log_p[order], c[order].astype(COUNT)]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        stops = np.append(starts, len(bucket))[1:]
        packed = [pack(*(x[s:e] for x in columns)) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "pairs"])

    return shares.select("bucket", "key", "log_p", "c").mapInArrow(tidied(run), "bucket int, pairs binary")


@dataclass
class Scores:
    """Everything a text's score needs but the shares of words beyond the list, which come by row."""

    parent: Parent
    share: np.ndarray
    rare: np.ndarray
    unknown: np.ndarray
    spread: tuple[np.ndarray, np.ndarray]
    dense: np.ndarray
    ends: int
    buckets: int

    def scanned(self, docs: DataFrame, held_out: Column, text: str, keep: list[str]) -> DataFrame:
        """Texts as rows with what can be said at once (bucket below 0), and the packed pairs of the others' buckets."""
        lists = self.parent.lists
        m = lists.symbols + 1
        inner = docs.select(
            F.monotonically_increasing_id().alias("uid"), held_out.alias("held_out"), F.struct(*dict.fromkeys([*keep, text])).alias("doc"),
            learnt(held_out).alias("learnt"),
        )
        kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
        schema = f"bucket int, part bigint, pairs binary, place int, doc struct<{kept}>, held_out boolean, n_tokens bigint, n_known bigint, base double, model double"
        columns = ["bucket", "part", "pairs", "place", "doc", "held_out", "n_tokens", "n_known", "base", "model"]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches, BATCH_BYTES):
                rows, part = batch.column(2), batch.column(0)[0].as_py()
                train = batch.column(3).to_numpy(zero_copy_only=False)
                words = words_of(texts_of(rows.field(text)), NOT_BLANK)
                n, of = words.counts(), words.text_of()
                at, symbol = lists.find(words)
                on_list = at >= 0
                base = np.bincount(of[on_list], np.log10(lists.counts[at[on_list]] + 1), len(n)) + np.log10(self.ends + 1)
                known = np.bincount(of[on_list], minlength=len(n)) + (self.ends > 0)
                tokens = tokens_of(words, lists, at, symbol)
                u = tokens.before("symbol", lists.symbols)
                both = (u < m) & (tokens.symbol < m)
                score = np.bincount(tokens.text[both], self.dense[u[both], tokens.symbol[both]], len(n))
                doc = pa.StructArray.from_arrays([rows.field(c) for c in keep], names=list(keep))
                lead = [np.full(len(n), -1 - int(mix(np.array([part], np.uint64))[0] % np.uint64(self.buckets)), np.int32), np.full(len(n), part, np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *map(pa.array, lead), pa.nulls(len(n), pa.binary()), pa.array(np.arange(len(n), dtype=np.int32)), doc, batch.column(1),
                        pa.array(n + 1), pa.array(known), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    ],
                    names=columns,
                )
                made = list(_dealt(tokens, lists, self.buckets, np.flatnonzero(~both), tokens.text * 2 + train[tokens.text], False))
                if made:
                    k = len(made)
                    blank = [pa.nulls(k, t) for t in (pa.int32(), doc.type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _ in made], pa.int32()), pa.array(np.full(k, part, np.int64)), pa.array([p for _, p in made], pa.binary()), *blank],
                        names=columns,
                    )

        return inner.mapInArrow(tidied(scan), schema)

    def bucket_scores(self, blobs: list[bytes], keys: np.ndarray, log_p: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """For each packed list of pairs: (text, log10 score, base, known words) packed, summed by text.
        keys, log_p, counts: the shares of words beyond the list, by ascending key."""
        parent, lists = self.parent, self.parent.lists
        end, m, discount = len(lists.keys), lists.symbols + 1, parent.discount
        u, w, values, other, last = _gathered(blobs, end)
        width = end + 1 + len(other)
        number, sizes = u * width + w, [len(v) for v in values]
        value = np.concatenate(values)
        order = np.argsort(number)
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        b = Bucket(u[order][first], w[order][first], np.add.reduceat(value[order] % 2, first), other, last)
        symbol = np.concatenate([lists.own, [lists.symbols], lists.symbols + 1 + last.astype(np.int64)])
        tables = parent.seated(b).mean(0)
        customers, all_tables = np.bincount(b.u, b.n, len(symbol)), np.bincount(b.u, tables, len(symbol))
        spread = symbol <= lists.symbols
        customers[spread], all_tables[spread] = self.spread[0][symbol[spread]], self.spread[1][symbol[spread]]
        own, new = own_and_new(b.n, tables, customers[b.u], all_tables[b.u], discount)
        found, seen = self.unknown[last], np.zeros(len(other))
        if len(keys) and len(other):
            at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
            there = keys[at] == other
            found, seen = np.where(there, log_p[at], found), np.where(there, counts[at], 0)
        rare = np.concatenate([self.rare, [1.0], 10.0**found])
        score = np.log10(own + new * self.share[symbol[b.u], symbol[b.w]] * rare[b.w])
        of_other = np.concatenate([np.zeros(end + 1), np.log10(seen + 1)])[b.w]
        known = np.concatenate([np.zeros(end + 1, bool), seen > 0])[b.w]
        out, low = [], 0
        for size in sizes:
            rows, text = pair[low : low + size], value[low : low + size] // 2
            texts = np.flatnonzero(np.bincount(text))
            sums = [np.bincount(text, x[rows])[texts] for x in (score, of_other, known)]
            out.append(pack(texts.astype(CODE), sums[0], sums[1], sums[2].astype(CODE)))
            low += size
        return out

    def scored(self, docs: DataFrame, held_out: Column, text: str, keep: list[str], shares: DataFrame) -> DataFrame:
        """doc, held_out, n_tokens, n_known, base, score of every row. shares: (bucket, key, log_p, c) of words beyond the list."""
        found = self.scanned(docs, held_out, text, keep)
        given = found.schema

        def judge(table: pa.Table) -> pa.Table:
            if table.column("bucket")[0].as_py() < 0:  # texts
                return table
            is_share = table.column("part").is_null().to_numpy()
            asked = [unpack(b, *SHARE) for b in table.filter(pa.array(is_share)).column("pairs").to_pylist()]
            keys, log_p, c = (np.concatenate([a[k] for a in asked] or [np.empty(0, t)]) for k, t in enumerate(SHARE))
            rows = table.filter(pa.array(~is_share))
            if not rows.num_rows:
                return rows
            order = np.argsort(keys)
            made = self.bucket_scores(rows.column("pairs").to_pylist(), keys[order], log_p[order], c[order])
            return rows.set_column(given.names.index("pairs"), "pairs", pa.array(made, pa.binary()))

        def gather(table: pa.Table) -> pa.Table:
            is_text = table.column("place").is_valid().to_numpy()
            texts = table.filter(pa.array(is_text))
            texts = texts.take(pa.array(np.argsort(texts.column("place").to_numpy())))
            sums = [texts.column(c).to_numpy().copy() for c in ("model", "base", "n_known")]
            blobs = sorted(zip(*(table.filter(pa.array(~is_text)).column(c).to_pylist() for c in ("bucket", "pairs")), strict=True))
            for _, blob in blobs:
                text, *parts = unpack(blob, CODE, np.dtype("<f8"), np.dtype("<f8"), CODE)
                for s, p in zip(sums, parts, strict=True):
                    s[text] += p.astype(s.dtype)
            kept = [texts.column(c) for c in ("doc", "held_out", "n_tokens")]
            return pa.table([*kept, pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0])], names=["doc", "held_out", "n_tokens", "n_known", "base", "score"])

        both = found.unionByName(packed_shares(shares), allowMissingColumns=True)
        judged = both.groupBy("bucket").applyInArrow(_released(judge), given)
        out = found.select("doc", "held_out", "n_tokens", "n_known", "base", F.col("model").alias("score")).schema
        return judged.groupBy("part").applyInArrow(_released(gather), out)
