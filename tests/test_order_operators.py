"""Order-dependent operators against plain loops, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from packwise.operators import lines, tokens
from packwise.operators.ordering import number_within, with_lookahead

TOKEN_SCHEMA = "insp_no int, panel_no int, seq int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"


def _boxes(seed: int, panels: int = 12, most: int = 40):
    rnd, rows = random.Random(seed), []
    for p in range(panels):
        for s in range(most * 4 if p == 0 else most):
            x, y = rnd.randrange(900), rnd.randrange(300)
            rows.append((1, p, s, rnd.choice(["a", "bb", "cccc", "dddddddd"]), rnd.randrange(40, 100) / 100,
                         x, y, x + rnd.randrange(5, 200), y + rnd.randrange(5, 60)))
    return rows


def test_numbers_match_a_sorted_list(spark):
    rows = [(1 if i % 3 else i, i * 7919 % 1000, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = number_within(df, ["k"], ["v", "i"], F.floor(F.col("v") / 100), "no").collect()
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    assert {r["i"]: r["no"] for r in got} == want


def test_lookahead_crosses_blocks(spark):
    sizes = {1: 100, 2: 3, 3: 17}
    rows = [(k, n, f"{k}.{n}") for k, size in sizes.items() for n in range(1, size + 1)]
    df = spark.createDataFrame(rows, "k int, n int, t string")
    got = with_lookahead(df, ["k"], "n", F.col("t"), ahead=4, block=8).collect()
    assert len(got) == len(rows)
    for r in got:
        for d in (1, 2, 3, 4):
            ahead = r["n"] + d
            assert r[f"next{d}"] == (f"{r['k']}.{ahead}" if ahead <= sizes[r["k"]] else None)


def _rows_by_loop(boxes):
    groups = []
    for t in sorted(boxes, key=lambda t: (t[6], t[5], t[2])):
        th = max(1, t[8] - t[6])
        for g in groups:
            lo, hi = min(m[6] for m in g), max(m[8] for m in g)
            gh = max(1, hi - lo)
            if max(th, gh) / min(th, gh) > 2.2:
                continue
            if max(0, min(t[8], hi) - max(t[6], lo)) / min(th, gh) >= 0.45:
                g.append(t)
                break
        else:
            groups.append([t])
    return {frozenset(m[2] for m in g) for g in groups}


def test_row_groups_match_a_loop(spark):
    rows = _boxes(1)
    got = {}
    for r in lines.group_rows(spark.createDataFrame(rows, TOKEN_SCHEMA)).collect():
        got.setdefault((r["panel_no"], r["band"], r["grp"]), set()).add(r["seq"])
    for p in {r[1] for r in rows}:
        mine = {frozenset(v) for k, v in got.items() if k[0] == p}
        assert mine == _rows_by_loop([r for r in rows if r[1] == p])


def _iou(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[7] - r[5]) * (r[8] - r[6])
    return w * h / (area(a) + area(b) - w * h)


def test_merge_matches_a_loop(spark):
    first, rnd = _boxes(2), random.Random(3)
    second = [(i, p, s, t + rnd.choice(["", "zzzzz"]), rnd.randrange(40, 100) / 100, x + rnd.randrange(9), y, x2 + 3, y2 + rnd.randrange(4))
              for i, p, s, t, c, x, y, x2, y2 in first if rnd.random() < 0.7]
    got = tokens.merge_passes(spark.createDataFrame(first, TOKEN_SCHEMA), spark.createDataFrame(second, TOKEN_SCHEMA))
    mine = {(r["panel_no"], r["source"], r["seq"]): (r["text"], r["confidence"], r["x_min"]) for r in got.collect()}
    want = {}
    for p in {r[1] for r in first}:
        acc = [[(1, t[2]), t] for t in first if t[1] == p]
        for tb in (t for t in second if t[1] == p):
            best, at = 0.0, -1
            for i, (_, m) in enumerate(acc):
                if _iou(m, tb) > best:
                    best, at = _iou(m, tb), i
            if best >= 0.40:
                m = acc[at][1]
                if tb[4] > m[4] + 0.10 or len(tb[3]) > len(m[3]) + 3:
                    acc[at][1] = tb
            else:
                acc.append([(2, tb[2]), tb])
        want.update({(p, *key): (t[3], t[4], t[5]) for key, t in acc})
    assert mine == want


def test_lines_read_left_to_right_and_split_columns(spark):
    rows = [
        (1, 1, 1, "500", 0.9, 60, 10, 90, 30), (1, 1, 2, "NET", 0.8, 10, 11, 50, 31), (1, 1, 3, "far", 0.7, 400, 10, 440, 30),
        (1, 1, 4, "side", 0.9, 700, 5, 712, 80), (1, 1, 5, "dim", 0.1, 10, 60, 40, 80),
    ]
    got = lines.normalize(spark.createDataFrame(rows, TOKEN_SCHEMA)).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in got] == [(1, "side"), (2, "NET 500"), (3, "far")]


def test_token_cleaning(spark):
    given = ["5OO g", "Rs.1O.5O", "25STICKS", "Pi:1800", "q@itcin", "R 1/-", "~", "ＭＲＰ　10", " x\t y "]
    want = ["500 g", "Rs.10.50", "25 STICKS", "Ph: 1800", "q@itc.in", "Rs. 1/-", "", "MRP 10", "x y"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, text string")
    got = {r["i"]: r["text"] for r in tokens.with_clean_text(df).collect()}
    assert [got[i] for i in range(len(given))] == want


def _one_large_panel(rows: int = 1000, words: int = 5):
    """Rows of words with a tall side-bar beside them, which is as high as the panel."""
    boxes = [(1, 1, 0, "side", 0.9, 2000, 0, 2030, 24 * rows)]
    for r in range(rows):
        for w in range(words):
            y = 24 * r + (w * 7 + r) % 5
            boxes.append((1, 1, 1 + r * words + w, "ab" * (1 + w), 0.6, 10 + 120 * w, y, 110 + 120 * w, y + 22))
    return boxes


def test_a_panel_of_5000_tokens_with_a_side_bar(spark):
    first, rnd = _one_large_panel(), random.Random(5)
    second = [(i, p, s, t + "zzzz" * (s % 2), rnd.randrange(40, 100) / 100, x + 2, y + rnd.randrange(3), x2 + 2, y2)
              for i, p, s, t, c, x, y, x2, y2 in first if s % 3] + [(1, 1, 9000, "new", 0.5, 900, 40, 960, 60)]
    a, b = spark.createDataFrame(first, TOKEN_SCHEMA), spark.createDataFrame(second, TOKEN_SCHEMA)
    both = a.withColumn("pass", F.lit(1)).unionByName(b.withColumn("pass", F.lit(2)))
    largest = tokens.with_blocks(both, ["panel_no"], 0.40).groupBy("panel_no", *tokens.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest <= 4
    got = {(r["source"], r["seq"]): (r["text"], r["confidence"], r["x_min"]) for r in tokens.merge_passes(a, b).collect()}
    want = {(1, t[2]): (t[3], t[4], t[5]) for t in first}
    for t in second:
        old = want.get((1, t[2]))
        if old is None:
            want[2, t[2]] = (t[3], t[4], t[5])
        elif t[4] > old[1] + 0.10 or len(t[3]) > len(old[0]) + 3:
            want[1, t[2]] = (t[3], t[4], t[5])
    assert got == want


def test_row_groups_of_one_strip_of_thousands(spark):
    """Every row touches the next, so the panel is one strip; groups are retired on the way."""
    rnd = random.Random(6)
    rows = [(1, 1, n, "w", 0.9, rnd.randrange(900), 9 * n // 4, 1000, 9 * n // 4 + rnd.randrange(12, 30)) for n in range(3000)]
    found = lines.group_rows(spark.createDataFrame(rows, TOKEN_SCHEMA)).collect()
    assert len({r["band"] for r in found}) == 1
    got = {}
    for r in found:
        got.setdefault(r["grp"], set()).add(r["seq"])
    assert {frozenset(v) for v in got.values()} == _rows_by_loop(rows) and len(got) > 100


def test_block_cuts_part_no_boxes_that_meet(spark):
    """Random boxes of every shape: all pairs of at least the wanted overlap share a block."""
    rows = [r for seed in (11, 12, 13) for r in _boxes(seed, panels=4, most=30)]
    rows = [(i, p, n, *rest) for n, (i, p, _, *rest) in enumerate(rows)]
    for least in (0.25, 0.40, 0.9):
        df = tokens.with_blocks(spark.createDataFrame(rows, TOKEN_SCHEMA), ["panel_no"], least)
        block = {r["seq"]: (r["panel_no"], *[r[b] for b in tokens.BLOCK]) for r in df.collect()}
        for a in rows:
            for b in rows:
                if a[1] == b[1] and _iou(a, b) >= least:
                    assert block[a[2]] == block[b[2]]


def test_strips_and_blocks_without_a_fold(spark):
    """A strip whose tokens all share enough height is one group without a fold over them, and the next strip is folded;
    a token seen once, or once by each pass, needs no fold either."""
    from packwise.operators import lines, tokens

    boxes = [(1, 1, 1, "a", 0.9, 0, 30, 20, 50), (1, 1, 2, "b", 0.9, 30, 32, 50, 52), (1, 1, 3, "c", 0.9, 60, 29, 80, 49),
             (1, 1, 4, "d", 0.9, 0, 100, 20, 120), (1, 1, 5, "e", 0.9, 30, 116, 50, 136)]
    box = "insp_no long, panel_no int, seq int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"
    grouped = lines.group_rows(spark.createDataFrame(boxes, box))
    assert sorted((r.seq, r.band, r.grp, r.ord) for r in grouped.collect()) == [
        (1, 29, 1, 1), (2, 29, 1, 2), (3, 29, 1, 0), (4, 100, 1, 0), (5, 100, 2, 1)]
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat" in plan.lower()
    again = [(1, 1, 1, "A", 0.95, 1, 30, 21, 50), (1, 1, 2, "bbbbbbbbbb", 0.1, 31, 32, 51, 52), (1, 1, 9, "z", 0.5, 500, 30, 520, 50),
             (1, 1, 4, "D", None, 0, 100, 20, 120)]
    merged = tokens.merge_passes(spark.createDataFrame(boxes, box), spark.createDataFrame(again, box))
    assert sorted((r.source, r.seq, r.text) for r in merged.collect()) == [
        (1, 1, "a"), (1, 2, "bbbbbbbbbb"), (1, 3, "c"), (1, 4, "d"), (1, 5, "e"), (2, 9, "z")]
