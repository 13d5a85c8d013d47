"""Vector code compression: one codebook for each part of the vectors, fitted by rounds of exact nearest-entry search.

Components become integers, floor(scale * x), and vectors are cut into equal parts. Entries start as the parts of the vectors
with the smallest ids; each round assigns every part to its nearest entry and moves each entry to its parts' mean.

**Bounds.** A row keeps, for each part, an upper bound of the distance to its own entry and, for each group of entries, a
lower bound of the distance to all others of the group, each with the round at which it was exact (its stamp). The codebooks of
all rounds are kept, so in round t a bound of round s is corrected by the true net displacement |C_t[j] - C_s[j]| of an
entry, the norm of the sum of its moves, which is never more than the sum of their norms that accumulated drifts would take
off. Only where a corrected lower bound does not exceed the upper bound are the entries of that group scanned again,
exactly. Entries of a group lie close to each other (halved along the widest component), so that one bound serves many.

Bounds are kept with a margin far above rounding errors and equality is scanned, so results are those of a full search.
Sums go through partial sums in tasks; what reaches the driver are the codebooks alone (entries * components numbers).
The state between rounds is a written table in one of two places in turn: a lost executor costs its tasks of one round, and
no more than two rounds take space.

Defined cases: vectors that are null, empty or hold null or non-finite components (also after scaling) take no part; shorter
vectors count as if zeros followed up to the longest, and that up to a multiple of the parts; vectors without an id are
coded but start no entry; of equal ids the smaller vector comes first; with fewer vectors than entries there are fewer
entries; components of any size are computed exactly, and an error beyond 64 bits is null; repeated rows are coded each; an
empty table gives no rows; `doc` holds the kept columns, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.tables import TwoPlaces, rows_of, smallest, staged, tidied, whole_vector
from packwise.llm.voronoi_knn import matrix

_SAFE = 2.0**22  # below, squared distances of up to 128 components are exact in doubles
_LIMB = 10**18  # sums of any size travel as limbs


def whole(values: np.ndarray) -> np.ndarray:
    """Python's whole numbers, which have no greatest size."""
    return np.frompyfunc(int, 1, 1)(values)


def numbers(values: list) -> np.ndarray:
    """Whole numbers as doubles where those hold them, else as Python's."""
    return np.array(values, float) if all(abs(v) < 2**53 for v in np.array(values, object).flat) else np.array(values, object)


def _roots(squares: np.ndarray, beyond: float) -> np.ndarray:
    if squares.dtype == object:
        squares = np.array([float(s) if s < 2**1000 else beyond**2 for s in squares])
    return np.where(np.isinf(squares) & (beyond < 0), beyond, np.sqrt(squares))


def _exact(x: np.ndarray, entries: np.ndarray) -> bool:
    return x.shape[1] <= 128 and max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < _SAFE


def all_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries."""
    if _exact(x, entries):
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    x = whole(x)
    return np.stack([((x - e) ** 2).sum(1) for e in whole(entries)], axis=1)


def own_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the entry beside it."""
    if _exact(x, entries):
        return ((x - entries) ** 2).sum(1)
    return ((whole(x) - whole(entries)) ** 2).sum(1)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry: halves along the widest component, again and again."""
    sets = [np.arange(len(entries))]
    while len(sets) < groups and max(map(len, sets)) > 1:
        halves = []
        for own in sets:
            order = own[np.argsort(entries[own][:, np.ptp(entries[own], axis=0).argmax()], kind="stable")]
            halves += [order[: (len(own) + 1) // 2], order[(len(own) + 1) // 2 :]]
        sets = [s for s in halves if len(s)]
    out = np.zeros(len(entries), np.int64)
    for g, own in enumerate(sets):
        out[own] = g
    return out


class Search:
    """Nearest entries in the last of the kept codebooks; books: (parts, entries, size) for each round so far."""

    def __init__(self, books: list[np.ndarray], groups: int):
        self.books, self.now = books, len(books) - 1
        self.parts, self.entries, self.size = books[0].shape
        self.group = np.array([grouped(part.astype(float), groups) for part in books[0]])
        self.groups = int(self.group.max()) + 1
        last = books[-1].astype(float)
        #: moved[s, p, j]: net displacement of an entry since round s; farthest[s, p, g]: the largest of a group
        self.moved = np.array([np.sqrt(((last - book.astype(float)) ** 2).sum(2)) for book in books]) * (1 + 1e-9)
        self.farthest = np.zeros((len(books), self.parts, self.groups))
        for p in range(self.parts):
            for g in set(self.group[p].tolist()):
                self.farthest[:, p, g] = self.moved[:, p, self.group[p] == g].max(1)
        self.state = np.dtype(
            [("code", "<u2", self.parts), ("upper", "<f4", self.parts), ("at", "u1", self.parts),
             ("lower", "<f4", (self.parts, self.groups)), ("seen", "u1", (self.parts, self.groups))]
        )

    def fresh(self, n: int) -> np.ndarray:
        state = np.zeros(n, self.state)
        state["upper"], state["lower"] = np.inf, -1
        return state

    def assign(self, x: np.ndarray, state: np.ndarray) -> int:
        """Bring the state to this round; returns how many (row, part, entry) were scanned."""
        return sum(self._part(p, x[:, p * self.size : (p + 1) * self.size], state) for p in range(self.parts))

    def _part(self, p: int, x: np.ndarray, state: np.ndarray) -> int:
        book, group = self.books[-1][p], self.group[p]
        own = state["code"][:, p].astype(np.int64)
        upper = state["upper"][:, p] + self.moved[state["at"][:, p], p, own]
        lower = state["lower"][:, p] - self.farthest[state["seen"][:, p], p, np.arange(self.groups)]
        rows = np.flatnonzero(~(lower.min(1) > upper))
        squares = own_distances(x[rows], book[own[rows]])  # the distance to the own entry may settle it
        tight = _roots(squares, np.inf) * (1 + 1e-6)
        state["upper"][rows, p], state["at"][rows, p] = tight, self.now
        going = np.flatnonzero(~(lower[rows].min(1) > tight))
        rows, best, tight = rows[going], squares[going], tight[going]
        if not len(rows):
            return 0
        x, was, lower = x[rows], own[rows], lower[rows]
        code, failing, scans = was.copy(), ~(lower > tight[:, None]), 0
        nearest, second = np.full(failing.shape, np.inf), np.full(failing.shape, np.inf)
        first = np.full(failing.shape, -1)
        for g in range(self.groups):
            at, members = np.flatnonzero(failing[:, g]), np.flatnonzero(group == g)
            if not len(at) or not len(members):
                continue
            scans += len(at) * len(members)
            squares, line = all_distances(x[at], book[members]), np.arange(len(at))
            least = squares.argmin(1)  # members ascend: of equal ones the lowest
            near, found = squares[line, least], members[least]
            better = (near < best[at]) | ((near == best[at]) & (found < code[at]))
            best[at[better]], code[at[better]] = near[better], found[better]
            nearest[at, g], first[at, g] = _roots(near, -1), found
            squares[line, least] = np.inf
            second[at, g] = _roots(squares.min(1), -1) if len(members) > 1 else np.inf
        # of a scanned group: the nearest entry that is not the row's own
        fresh = np.where(first == code[:, None], second, nearest)
        stored, seen = state["lower"][rows, p].astype(float), state["seen"][rows, p]
        stored, seen = np.where(failing, fresh, stored), np.where(failing, self.now, seen)
        left = np.flatnonzero(code != was)
        left = left[~failing[left, group[was[left]]]]  # the entry left behind joins the others of a group not scanned
        stored[left, group[was[left]]] = np.minimum(lower[left, group[was[left]]], tight[left])
        seen[left, group[was[left]]] = self.now
        changed = failing.copy()
        changed[left, group[was[left]]] = True
        state["lower"][rows, p] = np.where(changed, np.minimum(stored, 3e38) * (1 - 1e-5), stored)
        state["seen"][rows, p], state["code"][rows, p] = seen, code
        state["upper"][rows, p] = _roots(best, np.inf) * (1 + 1e-6)
        return scans

    def errors(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Squared distance of each row to its entries, over all parts."""
        entries = np.concatenate([self.books[-1][p][state["code"][:, p]] for p in range(self.parts)], axis=1)
        return own_distances(x, entries)


def partial_sums(parts: int, entries: int, size: int):
    """For mapInArrow over (v, state): counts (place -1) and sums of the parts of each entry, as limbs."""

    def run(batches: Iterator[pa.RecordBatch], state: np.dtype) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        totals = np.zeros((parts, entries, size), object)
        for batch in rows_of(batches):
            x = matrix(batch.column(0), parts * size)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), state)["code"].astype(np.int64)
            safe = np.abs(x).max(initial=0) * len(x) < 2.0**53
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                for d in range(size):
                    values = x[:, p * size + d]
                    if safe:
                        totals[p, :, d] += np.bincount(code[:, p], values, entries).astype(np.int64)
                    else:
                        np.add.at(totals[p, :, d], code[:, p], whole(values))
        out = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts), strict=True)]
        for p, e, d in zip(*np.nonzero(totals), strict=True):
            rest, limb = int(totals[p, e, d]), 0
            while rest and rest != -1 or not limb:
                last = -_LIMB < rest < _LIMB
                rest, low = (0, rest) if last else divmod(rest, _LIMB)
                out.append((p, e, d, limb, low))
                limb += 1
            if rest == -1:
                out.append((p, e, d, limb, -1))
        columns = [pa.array([int(r[i]) for r in out], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "limb", "value"])

    return run


def digest_of(book: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in book.flat).encode()).hexdigest()


def coded(
    vectors: DataFrame, keep: list[str], *, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4,
    scale: int = 1024, groups: int = 8,
) -> tuple[DataFrame, np.ndarray | None]:
    """doc (columns in keep), code (indexes in part order, hex), error (squared distance over all parts); and the codebooks
    (parts, entries, size), None for an empty table."""
    names, spark = list(keep), vectors.sparkSession
    doc = F.struct(*names).alias("doc")
    rows = vectors.select(doc, F.col(vec_id).alias("id"), whole_vector(vector, scale).alias("v")).where("v is not null")
    kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in vectors.select(*names).schema)
    result = f"doc struct<{kept}>, code string, error bigint"
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    first = smallest(rows.where("id is not null").select("id", "v"), ["id", "v"], entries).select("v").collect() if longest else []
    if not first:
        if longest:
            raise ValueError("no vector has an id: no entry can start")
        return spark.createDataFrame([], result), None
    size = -(-longest // parts)
    start = np.stack([np.pad(np.array(r.v, float), (0, parts * size - len(r.v))) for r in first])
    books = [numbers(whole(start).reshape(-1, parts, size).transpose(1, 0, 2).tolist())]
    digits = max(1, (len(str(f"{len(first) - 1:x}")))) if len(first) > 256 else 2

    def step(search: Search, fresh: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches):
                x = matrix(batch.column(1), parts * size)
                state = search.fresh(len(x)) if fresh else np.frombuffer(b"".join(batch.column(2).to_pylist()), search.state).copy()
                search.assign(x, state)
                made = pa.array([s.tobytes() for s in state], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["doc", "v", "state"])

        return run

    def last(search: Search, fresh: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows_of(batches):
                x = matrix(batch.column(1), parts * size)
                state = search.fresh(len(x)) if fresh else np.frombuffer(b"".join(batch.column(2).to_pylist()), search.state).copy()
                search.assign(x, state)
                codes = ["".join(f"{c:0{digits}x}" for c in own) for own in state["code"].tolist()]
                errors = [int(e) if e < 2**63 else None for e in search.errors(x, state)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes), pa.array(errors, pa.int64())], names=["doc", "code", "error"])

        return run

    rows, places = rows.select("doc", "v"), TwoPlaces(spark)
    for done in range(rounds):
        search = Search(books, groups)
        rows = places.put(rows.mapInArrow(tidied(step(search, done == 0)), f"doc struct<{kept}>, v array<double>, state binary"))
        sums, state = partial_sums(parts, len(first), size), search.state
        partial = rows.select("v", "state").mapInArrow(tidied(lambda b, sums=sums, state=state: sums(b, state)), "part long, entry long, place long, limb long, value long")
        total = partial.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        counts, gathered = np.zeros((parts, len(first)), object), np.zeros(books[0].shape, object)
        for r in total.collect():  # entries * (components + parts) numbers
            if r.place < 0:
                counts[r.part, r.entry] = int(r.value)
            else:
                gathered[r.part, r.entry, r.place] += int(r.value) * _LIMB**r.limb
        books.append(numbers(np.where(counts[:, :, None] > 0, gathered // np.maximum(counts, 1)[:, :, None], whole(books[-1])).tolist()))
    return staged(rows.mapInArrow(tidied(last(Search(books, groups), rounds == 0)), result)), books[-1]
