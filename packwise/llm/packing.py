"""Best-fit packing of token sequences with certified bin counts.

Texts become token pieces of at most `capacity`. Pieces are dealt to partitions of about `part_size`, and best-fit
decreasing packs each. Dual feasible functions give a lower bound of the bins a partition needs: where it is met, the
partition is certified. As long as all partitions together use more bins than the bound over all pieces asks for, they close their full
bins, exchange the pieces of all other bins (dealt anew by bin) and run again, until a round saves nothing.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows; a very
long text is cut into pieces like any other; `doc` holds the kept columns, so no name can clash.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.tables import held, rows_of, staged, texts_of, tidied
from packwise.llm.token_stream import byte_letters

_WORDS = re.compile(r"[^ \t\n\r]+")
_ODD_BLANKS = re.compile("[\x1c-\x1f]")  # blanks for str.split, but not for the tokenizer
#: The tokenizer always cuts between a letter or digit and these marks. Only ASCII ones are taken: some other letters are
#: normalised into a letter and a mark, which joins the marks behind it.
_WITH_MARKS = re.compile(r"([^\W_]*[A-Za-z0-9])([.,;:!?|#$%&*]+)")
#: Letters that normalisation only lower-cases, each by itself, and marks behind them: the letters are one word for the model.
_LETTERS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,;:!?|#$%&*]*)")
#: A word of one token, put between words that are tokenized in one call.
_BETWEEN = "?"
_JOINT = f" {_BETWEEN} "
_FEW = 4096
_RUNS_OF_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cuts_runs_of_letters(path: str) -> bool:
    """Whether the tokenizer lower-cases a word of `_LETTERS` and passes it to its model whole, written by byte."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, cut = (spec[step] or {} for step in ("normalizer", "pre_tokenizer"))
    split, *level = cut.get("pretokenizers") or [{}]
    return (
        [n["type"] for n in before.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
        and (before["normalizers"][1]["pattern"], before["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ")
        and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
        and split["pattern"] == {"Regex": _RUNS_OF_LETTERS}
        and [(p["type"], p["use_regex"], p["add_prefix_space"]) for p in level] == [("ByteLevel", False, False)]
        and not any(c.isalpha() for t in spec["added_tokens"] for c in t["content"][:1])
        and not spec["model"]["dropout"]
    )


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Token ids (as little-endian uint32 bytes) of blank-separated words, which no token spans. The table has two halves of
    `most_bytes` / 2: when one is full, it takes the place of the older one, whose words that were not met again are forgotten.
    Words that end in marks share the ids of their first part, and words of `_LETTERS` or ASCII those of their lower-case form."""

    def __init__(self, path: str, most_bytes: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.most_bytes, self.held, self.older = tokenizer.encode, most_bytes, 0, {}
        mark = self.encode(_BETWEEN, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # the model alone takes a third of the time of a call that also normalises and cuts
        self.tokens_of = tokenizer.model.tokenize if _cuts_runs_of_letters(path) else None
        self.alone = _LETTERS.fullmatch if self.tokens_of else lambda word: None
        self.letters = dict(enumerate(byte_letters()))
        self.asked = _FEW  # words that were no words of letters, since the last call of `learn`

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            parts = self.alone(word)
            if parts:
                low, marks = parts[1].lower(), parts[2]
                if low != word:
                    seen = low in self
                    ids = self[low] + self[marks] if marks else self[low]
                    if not seen:  # most words that are new are not met again: one entry is enough until then
                        return ids
                else:
                    written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                    ids = _packed([token.id for token in self.tokens_of(written)])
            else:
                ids = self.made(word)
        self.hold(word, ids)
        return ids

    def made(self, word: str) -> bytes:
        parts = None if word.isalnum() else _WITH_MARKS.fullmatch(word)
        if parts:
            return self[parts[1]] + self[parts[2]]
        if word.isascii() and word != (low := word.lower()):
            return self[low]
        self.asked += 1
        return _packed(self.encode(word, add_special_tokens=False).ids)

    def hold(self, word: str, ids: bytes) -> None:
        self.held += 200 + 2 * len(word) + len(ids)  # about what an entry takes
        if 2 * self.held > self.most_bytes:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[word] = ids

    def learn(self, lists: list[list[str]], together: int = 32) -> None:
        """Tokenize the new words of these lists that the model does not take alone, many in one call: a call for each word
        costs more than its tokens do. To look for them costs more than that, if the lists before had few."""
        few, self.asked = self.asked < _FEW, 0
        if self.mark is None or few:
            return
        new = set()
        for word in set().union(*lists):
            if word in self or self.alone(word) or word in self.older:
                continue
            parts = None if word.isalnum() else _WITH_MARKS.fullmatch(word)
            word = parts[1] if parts else word
            new.add(word.lower() if word.isascii() else word)
        new = [w for w in new if w not in self and w not in self.older and not self.alone(w) and len(w) <= 64 and _BETWEEN not in w]
        self.asked = len(new)
        for at in range(0, len(new), together):
            some = new[at : at + together]
            found = np.array(self.encode(_JOINT.join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(found == self.mark)
            if len(cuts) == len(some) - 1:  # otherwise a word has the token of the mark: these are tokenized one by one
                starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(found)]
                codes = found.tobytes()
                for word, start, end in zip(some, starts, ends, strict=True):
                    self.hold(word, codes[start:end])

    def split(self, text: str) -> list[str]:
        return _WORDS.findall(text) if _ODD_BLANKS.search(text) else text.split()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


def token_pieces(docs: DataFrame, keep: list[str], *, tokenizer: str, text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, table_bytes: int = 64 << 20) -> DataFrame:
    """doc (columns in keep), piece, start, length, ids_crc32 and, if asked for, ids of each piece of each text.
    table_bytes: what a worker may keep of words it has tokenized; the ids are the same whatever it is."""
    names, end, words = list(keep), np.array([end_id], "<u4").tobytes(), f"ids of {tokenizer}, {table_bytes}"
    inner = docs.select(F.struct(*dict.fromkeys([*keep, text])).alias("doc"))
    kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"doc struct<{kept}>, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words are tokenized once by a worker, not once by each of its tasks
        known, size = held(words, lambda: WordIds(tokenizer, table_bytes)), 4 * capacity
        for batch in rows_of(batches, 2 << 20):
            rows, row, made, codes = batch.column(0), [], [], []
            lists = list(map(known.split, texts_of(rows.field(text)).to_pylist()))
            known.learn(lists)
            for i, value in enumerate(lists):
                ids = b"".join(map(known.__getitem__, value)) + end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    row.append(i)
                    made.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        codes.append(np.frombuffer(part, "<u4").astype(np.int64))
            doc = pa.StructArray.from_arrays([rows.field(n) for n in names], names=names).take(pa.array(row, pa.int64()))
            numbers = np.array(made, np.int64).reshape(-1, 4)
            columns = [doc, pa.array(numbers[:, 0].astype(np.int32)), *(pa.array(numbers[:, j]) for j in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(codes, pa.list_(pa.int64()))] if with_ids else []),
                names=["doc", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else []),
            )

    return inner.mapInArrow(tidied(cut, holds=words), schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Free room is kept as one bit mask: bit r is set if a bin
    has exactly r left, so the tightest bin is the lowest set bit from the length on."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins, offsets, used


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that pieces need at least; histogram[n]: pieces of length n. The best of two families of dual feasible
    functions: thresholds (large pieces count whole, tiny ones nothing) and rounding to multiples of capacity / k."""
    n = np.arange(capacity + 1)
    many, total = histogram.astype(np.int64), int((histogram * n).sum())
    best = -(-total // capacity)
    count, weight = np.cumsum(many), np.cumsum(many * n)
    half = capacity // 2
    low = np.arange(0, half + 1)
    top = count[capacity] - count[capacity - low]  # longer than capacity - threshold
    middle, middle_sum = count[capacity - low] - count[half], weight[capacity - low] - weight[half]
    below = np.where(low > 0, weight[np.maximum(low - 1, 0)], 0)
    rest = weight[half] - below - (middle * capacity - middle_sum)
    best = max(best, int((top + middle + np.maximum(0, -(-rest // capacity))).max()))
    for k in range(1, 21):
        scaled = (k + 1) * n
        value = np.where(scaled % capacity == 0, k * n, (scaled // capacity) * capacity)  # times k
        best = max(best, -(-int((many * value).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, *, capacity: int = 2048, part_size: int = 20_000, rounds: int | None = None) -> DataFrame:
    """The pieces with sequence_id, offset, and certified (its partition's bins, or all together, met their lower bound).
    Without `rounds`, exchanges end when all bins meet the bound over all pieces or a round saves nothing."""
    pieces = staged(pieces.withColumn("uid__", F.monotonically_increasing_id()))
    columns = [c for c in pieces.columns if c != "uid__"]
    total, least = pieces.count(), sequences_needed(pieces, capacity)
    slim = pieces.select("uid__", F.col("length").cast("long").alias("n"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["n"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        need = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        return pd.DataFrame(
            {
                "uid__": rows["uid__"], "n": lengths, "part": rows["part"], "bin": bins, "at": offsets,
                "room": (fill < capacity)[bins], "certified": used == need,
            }
        )

    def solved(slim: DataFrame, many: int, k: int, *dealt_by: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*dealt_by, F.lit(k)), F.lit(max(1, round(many / part_size))))
        dealt = slim.select("uid__", "n", part.alias("part"))
        schema = "uid__ long, n long, part long, bin long, at long, room boolean, certified boolean"
        return staged(dealt.groupBy("part").applyInPandas(solve, schema).withColumn("round", F.lit(k).cast("long")))

    def bins_of(state: DataFrame):
        return state.groupBy("part", "bin").agg(F.count("*").alias("rows")).agg(F.count("*").alias("bins"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()

    state = solved(slim, total, 0, "uid__")
    done, active, closed, k = [state.where(~F.col("room"))], state.where("room"), 0, 0
    used, open_ = bins_of(state).bins, bins_of(active)
    while used > least and open_.bins > 1 and (rounds is None or k < rounds):
        k, closed = k + 1, used - open_.bins
        state = solved(active, open_.rows, k, "part", "bin")
        now = closed + bins_of(state).bins
        if now >= used:  # the exchange saved nothing: what stood stays
            break
        done, active, used = [*done, state.where(~F.col("room"))], state.where("room"), now
        open_ = bins_of(active)
    placed = active
    for d in done:
        placed = placed.unionByName(d)
    # round, partition and bin name a sequence; 2^32 partitions of 2^20 bins at most
    sequence = F.shiftleft("round", 52) + F.shiftleft("part", 20) + F.col("bin")
    certified = F.col("certified") | F.lit(used <= least)
    placed = placed.select("uid__", sequence.alias("sequence_id"), F.col("at").alias("offset"), certified.alias("certified"))
    return pieces.join(placed, "uid__").select(*columns, "sequence_id", "offset", "certified")


def sequences_needed(pieces: DataFrame, capacity: int = 2048) -> int:
    """The certified lower bound over all pieces at once, from their counts by length."""
    rows = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows:
        histogram[r["length"]] = r["count"]
    return lower_bound(histogram, capacity)
