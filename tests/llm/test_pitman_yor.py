import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from packwise.llm import pitman_yor
from packwise.llm.queries import QUERIES
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_base_columns_and_held_out_gain(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    counts, train = Counter(), 0
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    for i, t in texts.items():
        if not held[i]:
            counts.update(brute.words(t))
            train += 1
    total, distinct = sum(counts.values()) + train, len(counts) + 1
    rows = QUERIES["op8_pitman_yor_scores"](spark, folder).collect()
    assert len(rows) == len(texts)
    gain = 0.0
    for r in rows:
        own = [counts[w] for w in brute.words(texts[r.doc_id])] + [train]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c > 0 for c in own), total)
        assert math.isclose(r.base_score, sum(math.log10((c + 1) / (total + distinct + 1)) for c in own), rel_tol=1e-9)
        assert r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_probabilities_sum_to_one(spark):
    pairs = spark.createDataFrame([(0 * 5 + 1, 10), (1 * 5 + 2, 3), (1 * 5 + 4, 1), (4 * 5 + 0, 200)], "pair long, n long")
    logs = pitman_yor.symbol_model(pairs, 5, 2)
    assert np.allclose((10.0**logs).sum(1), 1, atol=1e-4)
    words = [(1, b"ax", 1), (2, b"bx", 4), (3, b"cx", 30), (4, b"ay", 2)]
    model, known = pitman_yor.rare_model(spark.createDataFrame(words, "key long, word binary, n long"), 2)
    p = {r.key: 10.0**r.log_p for r in known.collect()}
    assert math.isclose(p[1] + p[2] + p[3] + 10.0 ** model.unknown()[ord("x")], 1, rel_tol=1e-6)


def test_seatings_follow_the_exact_law():
    """Three customers of one dish: 1, 2 or 3 tables, with probabilities from the seating weights."""
    d, fresh = 0.5, 0.7
    weight = {1: (1 - d) * (2 - d), 2: fresh * (3 * (1 - d)), 3: fresh * fresh}
    total = sum(weight.values())
    seats = pitman_yor.seatings(np.full(20_000, 3), np.full(20_000, fresh), d, np.random.default_rng(8), 1, moves=12)[0]
    for t, w in weight.items():
        assert abs((seats == t).mean() - w / total) < 0.02
    wide = pitman_yor.seatings(np.array([0, 1, 5000]), np.array([1.0, 1.0, 3000.0]), d, np.random.default_rng(8), 2)
    assert (wide[:, 0] == 0).all() and (wide[:, 1] == 1).all() and (wide[:, 2] > 500).all()


def test_odd_rows(spark):
    rows = [(1, None, 5.0), (2, "", 6.0), (2, "", 6.0), (3, "A a " * 20_000, 7.0), (4, "x" * 200_000, 8.0), (5, "unseen", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = pitman_yor.scored(docs, F.col("doc_id") == 5, ["doc_id", "score"]).collect()
    assert sorted((r.doc.doc_id, r.doc.score, r.n_tokens) for r in got) == [(1, 5, 1), (2, 6, 1), (2, 6, 1), (3, 7, 40_001), (4, 8, 2), (5, 9, 2)]
    assert all(math.isfinite(r.score) for r in got)
    none = pitman_yor.scored(docs.limit(3), F.lit(True), ["doc_id"]).collect()
    assert [(r.train_tokens, r.base_score) for r in none] == [(0, 0.0)] * 3
    assert pitman_yor.scored(docs.limit(0), F.lit(False), ["doc_id"]).count() == 0
