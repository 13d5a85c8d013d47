import zlib

import numpy as np

from packwise.llm import byte_cnn
from packwise.llm.queries import QUERIES


def _flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op5_byte_cnn_quality"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    kept = [p for q, p in held if q == 1]
    assert np.mean([q == p for q, p in held]) > 0.96 and np.mean(kept) > 0.98


def test_a_text_scores_alike_alone_and_among_others():
    net = byte_cnn.Net.fresh(np.random.default_rng(0))
    texts = ["", "a", "x" * 255, "y" * 256, "z" * 1000, "é" * 40_000, "tail " * 300_000, ""]
    together = net.scores(*_flat(texts))
    assert np.allclose(together, [net.scores(*_flat([t]))[0] for t in texts], atol=1e-5)
    assert len(net.scores(*_flat([]))) == 0


def test_gradients_match_differences():
    net = byte_cnn.Net.fresh(np.random.default_rng(1))
    net.keep_places = True
    data, bounds = _flat(["hello world " * 60, "?!" * 50, "q"])
    flat, first = byte_cnn.laid_out(data, bounds)
    y, w = np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        p = np.clip(net.scores(data, bounds), 1e-7, 1 - 1e-7)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    grads = byte_cnn._gradients(net, flat, first, y, w)
    for param, grad in zip((net.embed, net.filters, net.bias, net.out, net.base), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, step = param[at].copy(), 1e-2
        param[at] = keep + step
        up = loss()
        param[at] = keep - step
        down = loss()
        param[at] = keep
        assert abs((up - down) / (2 * step) - grad[at]) < 0.15 * abs(grad[at]) + 1e-3


def test_labels_that_cannot_teach(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, None, 6), (2, None, 6)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "doc_id long, quality int")
    for marks, expected in ((labels, 1.0), (labels.limit(0), 0.5)):
        net = byte_cnn.train(docs, marks)
        assert sorted((r.doc.doc_id, r.doc.score, r.score) for r in byte_cnn.scored(docs, ["doc_id", "score"], net).collect()) == [
            (1, 5, expected), (2, 6, expected), (2, 6, expected),
        ]
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(byte_cnn.scored(docs, ["doc_id"], byte_cnn.train(docs, both)).collect()) == 3
