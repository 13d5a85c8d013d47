import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from packwise.llm import pitman_yor, seating
from tests.llm import brute


def test_rare_words_have_contexts_of_their_own(spark):
    """Words of one last byte: only pairs of words tell the order apart. No word is among the symbols."""
    rows = [(k, "ax bx") for k in range(40)] + [(100 + k, "cx dx") for k in range(40)]
    rows += [(200, "ax bx cx dx"), (201, "ax dx cx bx"), (202, "never seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for known in (100, 0):
        got = {r.doc.doc_id: r for r in pitman_yor.scored(docs, F.col("doc_id") >= 200, ["doc_id"], symbols=0, known=known).collect()}
        assert got[200].score > got[201].score + 1
        assert math.isclose(got[200].base_score, got[201].base_score, rel_tol=1e-12) and got[202].n_known == 1


def test_buckets_and_the_list_do_not_change_counts(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 300}{rng.choice('abc')}" for _ in range(rng.randrange(40))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = Counter(w for k, t in enumerate(texts) if k % 5 for w in brute.words(t))
    train = sum(k % 5 > 0 for k in range(len(texts)))
    total = sum(counts.values()) + train
    seen = {}
    for known, bucket_tokens in ((1 << 18, 1 << 20), (1 << 18, 100), (30, 100), (30, 1 << 20)):
        rows = pitman_yor.scored(docs, F.col("doc_id") % 5 == 0, ["doc_id"], symbols=8, known=known, bucket_tokens=bucket_tokens).collect()
        assert len(rows) == len(texts)
        for r in rows:
            own = [counts[w] for w in brute.words(texts[r.doc.doc_id])] + [train]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c > 0 for c in own), total)
            assert math.isclose(r.base_score, sum(math.log10((c + 1) / (total + len(counts) + 2)) for c in own), rel_tol=1e-9)
        seen[known, bucket_tokens] = np.array([r.score for r in sorted(rows, key=lambda r: r.doc.doc_id)])
    # a pair's seats come from its words, so how pairs are dealt changes nothing
    assert np.allclose(seen[1 << 18, 1 << 20], seen[1 << 18, 100], rtol=1e-9)
    assert np.allclose(seen[1 << 18, 1 << 20].sum(), seen[30, 100].sum(), rtol=0.05)


def test_stirling_numbers_and_draws_of_large_dishes():
    size = 1500
    for discount in (0.1, 0.5, 0.95):
        row, t = np.zeros(1), np.arange(1, size + 1)
        while len(row) < size:
            row = seating.next_row(row, discount)
        assert np.allclose(seating.log_stirling(np.full(size, size), t, discount) + math.lgamma(size + 1), row, atol=1e-7)
        for fresh in (0.01, 30.0):  # the seating of first blocks and single moves was far off this law
            p = np.exp((logs := row + t * np.log(fresh)) - logs.max())
            p /= p.sum()
            seeds = np.arange(4000, dtype=np.uint64)[None]
            drawn = seating.drawn_tables(np.full(4000, size), np.full(4000, fresh), discount, seeds)[0]
            mean = (p * t).sum()
            assert abs(drawn.mean() - mean) < 5 * math.sqrt((p * (t - mean) ** 2).sum() / 4000) + 1e-9
