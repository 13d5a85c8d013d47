import math

import numpy as np
import pytest

from checks.compare import connect, rows_of
from packwise.llm import vector_codes as vc
from packwise.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def brute(rows, parts, entries, rounds, scale):
    """rows: (key, id, vector). {key: [(code, error)]} and the codebooks, in whole numbers of Python."""
    kept = []
    for key, vec_id, v in rows:
        if v and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            kept.append((key, vec_id, [math.floor(x * scale) for x in v]))
    size = -(-max(len(v) for *_, v in kept) // parts)
    kept = [(key, i, v + [0] * (parts * size - len(v))) for key, i, v in kept]
    first = sorted((r for r in kept if r[1] is not None), key=lambda r: (r[1], r[2]))[:entries]
    books = [[v[p * size : (p + 1) * size] for *_, v in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for done in range(rounds + 1):
        found = [[near(v[p * size : (p + 1) * size], books[p]) for p in range(parts)] for *_, v in kept]
        if done < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [v[p * size : (p + 1) * size] for (*_, v), f in zip(kept, found, strict=True) if f[p][1] == j]
                    if own:
                        books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = sorted((key, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for (key, *_), f in zip(kept, found, strict=True))
    return [(k, c, e if e < 2**63 else None) for k, c, e in out], books


def _rows(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, int(rng.integers(0, n)) if i % 9 else None, (centres[rng.integers(6)] + 0.3 * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("seed", "dims", "entries"), [(1, 8, 12), (2, 6, 30), (3, 4, 5)])
def test_equals_plain_rounds(spark, seed, dims, entries):
    rows = _rows(seed, 150, dims)
    rows += [(200, 3, None), (201, 4, []), (202, 5, [None] * dims), (203, 6, [float("nan")] * dims), (204, 7, [1e308] * dims), (205, 8, [0.25])]
    rows += [(300 + i, 11, rows[4][2]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "key long, vec_id long, embedding array<double>, id int, state string").repartition(5)
    codes, books = vc.coded(df, ["key", "id"], parts=2, entries=entries, rounds=3, scale=16, groups=4)
    want, want_books = brute(rows, 2, entries, 3, 16)
    assert sorted((r.doc.key, r.code, r.error) for r in codes.collect()) == want
    assert books.astype(int).tolist() == want_books


def test_components_of_any_size(spark):
    rows = [(i, i, [x, -x, 3.0, 0.5]) for i, x in enumerate([1e30, 2e30, 1.5e30, 1e9, 2e9, 5.0, 6.0, 1e30, 5e17, 5e17])]
    codes, books = vc.coded(spark.createDataFrame(rows, "key long, vec_id long, embedding array<double>"), ["key"], parts=2, entries=4, rounds=2, scale=8, groups=2)
    want, want_books = brute(rows, 2, 4, 2, 8)
    assert sorted((r.doc.key, r.code, r.error) for r in codes.collect()) == want
    assert [[[int(v) for v in e] for e in p] for p in books] == want_books and any(e is None for *_, e in want)


def test_empty_table_and_no_ids(spark):
    schema = "vec_id long, embedding array<double>"
    codes, books = vc.coded(spark.createDataFrame([], schema), ["vec_id"])
    assert codes.count() == 0 and books is None
    with pytest.raises(ValueError, match="no vector has an id"):
        vc.coded(spark.createDataFrame([(None, [1.0])], schema), ["vec_id"])


def test_bounds_skip_work_and_net_displacement_is_tighter():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * (rng.normal(size=(40, 8))[rng.integers(40, size=4000)] + 0.05 * rng.normal(size=(4000, 8))))
    books, scanned, state = [x[:64].reshape(1, 64, 8)], [], None
    drifts = 0
    for _ in range(5):
        search = vc.Search(books, 8)
        state = search.fresh(len(x)) if state is None else state.copy()
        scanned.append(search.assign(x, state))
        full = vc.all_distances(x, books[-1][0])
        assert (state["code"][:, 0] == full.argmin(1)).all() and (search.errors(x, state) == full.min(1)).all()
        others = np.sqrt(np.where(np.arange(64) == state["code"], np.inf, full))
        for g in range(search.groups):  # bounds hold after correction
            least = others[:, search.group[0] == g].min(1)
            assert (state["lower"][:, 0, g] - search.farthest[state["seen"][:, 0, g], 0, g] <= least).all()
        made = [x[state["code"][:, 0] == j].mean(0) // 1 if (state["code"][:, 0] == j).any() else books[-1][0][j] for j in range(64)]
        books.append(np.array([made]))
        drifts += np.linalg.norm(books[-1][0] - books[-2][0], axis=1)
    assert scanned[0] == 4000 * 64 and sum(scanned[2:]) < 0.2 * 3 * 4000 * 64
    net = np.linalg.norm(books[-1][0] - books[0][0], axis=1)
    assert (net <= drifts + 1e-9).all() and (net < 0.99 * drifts).any()


def test_query_equals_sql(spark):
    df = QUERIES["op12_vector_codes"](spark, SMALL)
    cur = connect(SMALL).execute(SQL["op12_vector_codes"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
