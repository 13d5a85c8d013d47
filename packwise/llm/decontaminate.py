"""Benchmark decontamination: a set join of item windows with documents that looks at necessary tokens only.

Each benchmark item is cut into windows of `width` consecutive words (an item with fewer words is one window). A window is
the set of its shingles, at their places. All of them must occur in a document that contains the window, so it is enough
to look for one: the rarest, by counts over all documents. A document position with that shingle gives one candidate
start; length and position bounds drop starts whose window would leave the document, and the rest are compared word by
word. A word inside any occurrence is hit.

Defined cases: null or empty texts have no words and hit nothing; items without words have no window; repeated items or
windows count once per item id; repeated document rows are judged each on their own; an empty benchmark hits nothing.
Windows are handled in blocks of at most `block` windows (a pass over the documents for each block), so memory does not
grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.tables import annotated, rows_of, staged, texts_of, tidied
from packwise.llm.words import LETTERS_DIGITS, Words, run_of, runs, words_of


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item, window, words): each distinct window of each item, its hash and the hashes of its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            words, ids = words_of(texts_of(batch.column(1)), LETTERS_DIGITS), batch.column(0).to_pylist()
            item, window, inside = [], [], []
            for name, low, high in zip(ids, words.first[:-1], words.first[1:], strict=True):
                size = min(width, high - low)
                for at in range(low, high - size + 1) if size else ():
                    own = words.hashes[at : at + size]
                    item.append(name)
                    window.append(int(run_of(own).view(np.int64)))
                    inside.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(window, pa.int64()), pa.array(inside, pa.list_(pa.int64()))],
                names=["item", "window", "words"],
            )

    chosen = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("item").isNotNull())
    return chosen.mapInArrow(tidied(cut), "item string, window bigint, words array<bigint>").dropDuplicates(["item", "window"])


@dataclass
class Block:
    """Windows of a block: words (padded), widths, the items of each, and which shingles each has."""

    words: np.ndarray
    widths: np.ndarray
    items: list[list[str]]
    shingles: dict[int, np.ndarray]  # size: sorted distinct hashes

    @staticmethod
    def of(rows: list, shingle: int, width: int) -> Block:
        grouped: dict[int, tuple[list[int], list[str]]] = {}
        for r in rows:
            grouped.setdefault(r.window, (r.words, []))[1].append(r.item)
        words = np.zeros((len(grouped), width), np.uint64)
        widths = np.array([len(w) for w, _ in grouped.values()], np.int64)
        for i, (w, _) in enumerate(grouped.values()):
            words[i, : len(w)] = np.array(w, np.int64).view(np.uint64)
        block = Block(words, widths, [sorted(set(x)) for _, x in grouped.values()], {})
        for size in np.unique(np.minimum(widths, shingle)).tolist():
            own = [runs(words[i, : widths[i]], size) for i in np.flatnonzero(np.minimum(widths, shingle) == size)]
            block.shingles[size] = np.unique(np.concatenate(own))
        return block


def _places(words: Words, size: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions whose run of `size` words is in wanted (sorted), and its index there."""
    made = runs(words.hashes, size)
    index = np.minimum(np.searchsorted(wanted, made), len(wanted) - 1)
    at = np.flatnonzero(wanted[index] == made)
    text = np.searchsorted(words.first, at, "right") - 1
    inside = at + size <= words.first[text + 1]
    return at[inside], index[at[inside]]


def shingle_counts(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    sizes = block.shingles

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, v in sizes.items()}
        for batch in rows_of(batches):
            words = words_of(texts_of(batch.column(0)), LETTERS_DIGITS)
            for k, wanted in sizes.items():
                totals[k] += np.bincount(_places(words, k, wanted)[1], minlength=len(wanted))
        for k, n in totals.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), k, np.int32)), pa.array(seen), pa.array(n[seen])], names=["size", "slot", "n"]
            )

    out = {k: np.zeros(len(v), np.int64) for k, v in sizes.items()}
    made = docs.select(text).mapInArrow(tidied(count), "size int, slot bigint, n bigint").groupBy("size", "slot").agg(F.sum("n").alias("n"))
    for r in made.collect():  # at most one row for each shingle of the block
        out[r["size"]][r.slot] = r.n
    return out


@dataclass
class Prefixes:
    """For each shingle size: hashes, and by hash (from bounds[i] to bounds[i + 1]) the windows and their offsets."""

    hashes: np.ndarray
    bounds: np.ndarray
    windows: np.ndarray
    offsets: np.ndarray


def rarest(block: Block, counts: dict[int, np.ndarray], shingle: int) -> dict[int, Prefixes]:
    """The one necessary token of each window: its rarest shingle (ties: the smaller hash, then the first place)."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i, width in enumerate(block.widths.tolist()):
        size = min(width, shingle)
        own = runs(block.words[i, :width], size)
        seen = counts[size][np.searchsorted(block.shingles[size], own)]
        at = int(np.lexsort((np.arange(len(own)), own, seen))[0])
        found.setdefault(size, []).append((int(own[at]), i, at))
    out = {}
    for size, rows in found.items():
        rows.sort()
        hashes, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
        out[size] = Prefixes(
            hashes, np.append(first, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        )
    return out


def occurrences(words: Words, block: Block, prefixes: dict[int, Prefixes]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence of a window in the texts."""
    starts, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size, p in prefixes.items():
        at, index = _places(words, size, p.hashes)
        many = p.bounds[index + 1] - p.bounds[index]
        pair = np.repeat(p.bounds[index] - np.cumsum(many) + many, many) + np.arange(many.sum())
        at, window = np.repeat(at, many), p.windows[pair]
        start, width = at - p.offsets[pair], block.widths[window]
        text = np.searchsorted(words.first, at, "right") - 1
        fits = (start >= words.first[text]) & (start + width <= words.first[text + 1])
        start, window, width = start[fits], window[fits], width[fits]
        step = max(1, (1 << 20) // block.words.shape[1])
        for low in range(0, len(start), step):
            s, v, n = start[low : low + step], window[low : low + step], width[low : low + step]
            same = np.ones(len(s), bool)
            for k in range(block.words.shape[1]):
                inside = k < n
                same[inside] &= words.hashes[s[inside] + k] == block.words[v[inside], k]
            starts.append(s[same])
            windows.append(v[same])
    return np.concatenate(starts), np.concatenate(windows)


def _search(block: Block, prefixes: dict[int, Prefixes]):
    def search(texts: pa.Array) -> dict[str, pa.Array]:
        words = words_of(texts, LETTERS_DIGITS)
        start, window = occurrences(words, block, prefixes)
        order = np.argsort(start, kind="stable")
        start, window = start[order], window[order]
        cuts = np.searchsorted(start, words.first)
        spans, items = [], []
        for i in range(len(texts)):
            own = slice(cuts[i], cuts[i + 1])
            low = start[own] - words.first[i]
            spans.append(np.unique(np.stack([low, low + block.widths[window[own]]], 1), axis=0).ravel() if len(low) else [])
            items.append(sorted({x for w in np.unique(window[own]).tolist() for x in block.items[w]}))
        return {
            "n_words": pa.array(words.counts()),
            "spans": pa.array(spans, pa.list_(pa.int64())),
            "items": pa.array(items, pa.list_(pa.string())),
        }

    return search


def _covered(flat: list[int]) -> tuple[int, list[int]]:
    """Words inside any of the spans (start, end, start, end ...), and the merged spans."""
    merged: list[int] = []
    for low, high in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if merged and low <= merged[-1]:
            merged[-1] = max(merged[-1], high)
        else:
            merged += [low, high]
    return sum(merged[1::2]) - sum(merged[::2]), merged


def _judged(n_words: pa.Array, spans: pa.Array, items: pa.Array, least_share: float) -> dict[str, pa.Array]:
    made = [_covered(x) for x in spans.to_pylist()]
    hit, words = np.array([n for n, _ in made], np.int64), np.asarray(n_words)
    merged = pa.array([m for _, m in made], pa.list_(pa.int64()))
    return {
        "n_words": n_words, "n_hit": pa.array(hit), "items": items, "spans": merged,
        "contaminated": pa.array((hit > 0) & (hit >= least_share * words - 1e-9)),
    }


def _judging(search, least_share: float):
    return lambda texts: _judged(**search(texts), least_share=least_share)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 13,
    shingle: int = 4,
    least_share: float = 0.05,
    block: int = 200_000,
) -> DataFrame:
    """Judge every document: doc (columns in keep), n_words, n_hit, items (ids as sorted strings), spans (merged word
    ranges as a flat list of starts and ends), contaminated (n_hit > 0 and n_hit >= least_share * n_words)."""
    windows = staged(item_windows(items, item_id, item_text, width))
    blocks = max(1, -(-windows.count() // block))
    fields = "n_words bigint, spans array<bigint>, items array<string>"
    judged = "n_words bigint, n_hit bigint, items array<string>, spans array<bigint>, contaminated boolean"
    found, before = None, list(dict.fromkeys([*keep, text]))
    for b in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect()  # about `block` rows
        part = Block.of(rows, shingle, width)
        prefixes = rarest(part, shingle_counts(docs, text, part), shingle) if rows else {}
        if blocks == 1:  # searched and judged by one worker: a second one beside it would hold as much memory again
            return annotated(docs, text, keep, judged, _judging(_search(part, prefixes), least_share))
        if found is None:
            found = annotated(docs, text, before, fields, _search(part, prefixes))
        else:  # the next pass reads the documents it was handed and adds to what was found
            handed = found.select("doc.*", F.struct("n_words", "spans", "items").alias("so_far__"))
            last = b == blocks - 1
            found = annotated(handed, text, [*(keep if last else before), "so_far__"], fields, _search(part, prefixes)).select(
                F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in (keep if last else before)]).alias("doc"),
                "n_words",
                F.concat("doc.so_far__.spans", "spans").alias("spans"),
                F.array_sort(F.array_union("doc.so_far__.items", "items")).alias("items"),
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _judged(batch.column(1), batch.column(2), batch.column(3), least_share)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], names=["doc", *made])

    kept = "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in found.schema["doc"].dataType) + ">"
    return found.mapInArrow(tidied(judge), f"doc {kept}, {judged}")
