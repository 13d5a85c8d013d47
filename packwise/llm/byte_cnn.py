"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Bytes are embedded, filters of 8 bytes slide over the text in steps of 4, and chunks of 512 bytes that overlap by half
cover all of it. Each chunk keeps the highest response of every filter; mean, highest and lowest over a text's chunks
are combined into one probability. Training runs on the driver over a bounded sample (`per_class` labelled texts for
each label, the ones with the smallest hash, each seen through one window of `window` bytes at a hashed place); scoring
reads every byte of every text, in segments of bounded size.

Defined cases: a null or empty text is one chunk of padding and gets a score like any other; with no labels, or one label
only, the score is that label's share (0.5 without any); repeated rows are scored each; labels that are null do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.tables import annotated, rows_of, texts_of, tidied

STEP, HALF = 4, 256  # bytes between filter places; bytes of half a chunk
PLACES = HALF // STEP
DIMS, FILTERS = 8, 24
_SEGMENT = 2048  # half chunks worked on at a time


def laid_out(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each padded with zeros to whole half chunks; and each text's first half chunk."""
    sizes = np.diff(bounds)
    halves = (sizes + STEP + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(first[-1]) * HALF, np.uint8)
    shift = np.repeat(first[:-1] * HALF - bounds[:-1], sizes)
    out[np.arange(len(data)) + shift] = data
    return out, first


@dataclass
class Net:
    embed: np.ndarray  # (256, DIMS)
    filters: np.ndarray  # (2 * STEP * DIMS, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (3 * FILTERS,)
    base: np.ndarray  # (1,)
    constant: float | None = None

    @staticmethod
    def fresh(rng: np.random.Generator) -> Net:
        def draw(*shape):
            return (rng.standard_normal(shape) * 0.3).astype(np.float32)

        return Net(draw(256, DIMS), draw(2 * STEP * DIMS, FILTERS) * 0.5, np.zeros(FILTERS, np.float32), draw(3 * FILTERS) * 0.3, np.zeros(1, np.float32))

    def responses(self, flat: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of each filter in each half chunk, and its place. last: half chunks that end a text."""
        n = len(flat) // HALF
        best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int16)
        block = STEP * DIMS
        both = np.concatenate([self.filters[:block], self.filters[block:]], 1)
        ends = np.zeros(n, bool)
        ends[last] = True
        for low in range(0, n, _SEGMENT):
            high = min(n, low + _SEGMENT)
            part = flat[low * HALF : high * HALF + STEP]
            if len(part) < (high - low) * HALF + STEP:
                part = np.concatenate([part, np.zeros(STEP, np.uint8)])
            made = self.embed[part].reshape(-1, block) @ both
            place = made[:-1, :FILTERS] + made[1:, FILTERS:] + self.bias
            place = np.maximum(place, 0).reshape(high - low, PLACES, FILTERS)
            place[ends[low:high], -1] = 0  # the filter would reach into the next text
            where[low:high] = place.argmax(1) if self.keep_places else 0
            best[low:high] = place.max(1)
        return best, where

    keep_places = False

    def pooled(self, best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks (two neighbouring half chunks of one text), and each text's first chunk; mean, max, min by text."""
        halves = np.diff(first)
        n = np.maximum(1, halves - 1)
        start = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], n)
        partner = np.minimum(at + 1, np.repeat(first[1:] - 1, n))
        chunks = np.maximum(best[at], best[partner])
        total = np.add.reduceat(chunks, start[:-1], 0) / n[:, None]
        x = np.concatenate([total, np.maximum.reduceat(chunks, start[:-1], 0), np.minimum.reduceat(chunks, start[:-1], 0)], 1)
        return x, start, np.stack([at, partner])

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None or len(bounds) < 2:
            return np.full(len(bounds) - 1, self.constant or 0.5)
        flat, first = laid_out(data, bounds)
        best, _ = self.responses(flat, first[1:] - 1)
        x, _, _ = self.pooled(best, first)
        return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ self.out + self.base[0], -30, 30)))


def _gradients(net: Net, flat: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Of the weighted log loss, back through the places that won each maximum."""
    best, where = net.responses(flat, first[1:] - 1)
    x, start, pairs = net.pooled(best, first)
    z = x @ net.out + net.base[0]
    delta = ((1 / (1 + np.exp(-z)) - labels) * weights / weights.sum()).astype(np.float32)
    to_x = delta[:, None] * net.out
    at, partner = pairs
    left = best[at] >= best[partner]
    chunks = np.where(left, best[at], best[partner])
    n = np.diff(start)
    of = np.repeat(np.arange(len(n)), n)
    to_chunk = (to_x[:, :FILTERS] / n[:, None])[of]
    for k in (1, 2):
        hit = chunks == x[of, k * FILTERS : (k + 1) * FILTERS]
        share = np.add.reduceat(hit, start[:-1], 0, dtype=np.float32)
        to_chunk = to_chunk + hit * (to_x[:, k * FILTERS : (k + 1) * FILTERS] / share)[of]
    to_half = np.zeros_like(best)
    np.add.at(to_half, at, to_chunk * left)
    np.add.at(to_half, partner, to_chunk * ~left)
    to_half *= best > 0
    half, f = np.nonzero(to_half)
    g = to_half[half, f]
    place = half * HALF + where[half, f].astype(np.int64) * STEP
    padded = np.concatenate([flat, np.zeros(2 * STEP, np.uint8)])
    window = padded[place[:, None] + np.arange(2 * STEP)]
    to_filters = np.zeros_like(net.filters)
    np.add.at(to_filters.T, f, g[:, None] * net.embed[window].reshape(len(g), -1))
    back = (g[:, None] * net.filters.T[f]).reshape(-1, DIMS)
    to_embed = np.stack([np.bincount(window.ravel(), back[:, d], 256) for d in range(DIMS)], 1).astype(np.float32)
    to_bias = np.bincount(f, g, FILTERS).astype(np.float32)
    return [to_embed, to_filters, to_bias, x.T @ delta, np.array([delta.sum()], np.float32)]


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.01) -> Net:
    rng = np.random.default_rng(23)
    net = Net.fresh(rng)
    net.keep_places = True
    params = [net.embed, net.filters, net.bias, net.out, net.base]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])])
            flat, first = laid_out(np.frombuffer(b"".join(texts[i] for i in some), np.uint8), bounds)
            step += 1
            now = rate * (1 - step / (steps + 1))
            for p, g, m, v in zip(params, _gradients(net, flat, first, labels[some], weights[some]), first_moment, second_moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32) + now * 1e-3 * p
    net.keep_places = False
    return net


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, window: int = 4096) -> Net:
    """Fit on at most `per_class` texts for each label. Losses are weighted by the labels' shares in all of `labels`."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id__")).agg(F.max(label).cast("int").alias("label__"))
    shares = {r.label__: r.n for r in marked.groupBy("label__").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Net(*[np.zeros(0)] * 5, constant=float(next(iter(shares), 0.5)))
    chosen = [marked.where(F.col("label__") == k).orderBy(F.xxhash64("id__"), "id__").limit(per_class) for k in (0, 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            out = []
            for value, h in zip(texts_of(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = value.encode()
                at = h % max(1, len(raw) - window + 1)
                out.append(raw[at : at + window])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.binary())], names=["id", "label", "raw"])

    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * per_class rows
    rows = docs.select(F.col(doc_id).alias("id__"), F.col(text).alias("text__")).join(few, "id__")
    rows = rows.select(F.col("id__").cast("string"), "text__", F.pmod(F.xxhash64("id__", F.lit(1)), F.lit(2**31)), "label__")
    rows = rows.mapInArrow(tidied(cut), "id string, label int, raw binary").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: r.id)
    y = np.array([r.label for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Net(*[np.zeros(0)] * 5, constant=float(shares.get(1, 0) / sum(shares.values())))
    weight = np.array([shares[0] / max(1, (y == 0).sum()), shares[1] / max(1, (y == 1).sum())], np.float32)
    return fit([bytes(r.raw) for r in rows], y, weight[y.astype(int)])


def scored(docs: DataFrame, keep: list[str], net: Net, *, text: str = "text") -> DataFrame:
    """`doc` (columns in keep) and score of every row."""

    def score(texts: pa.Array) -> dict[str, pa.Array]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        return {"score": pa.array(net.scores(data, offsets - offsets[0]))}

    return annotated(docs, text, keep, "score double", score)
