"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental byte-to-text machine.

**Lookahead.** Merging by rank equals passes over the merge list in order. Whether the boundary b of two symbols is merged
by rule r = (u, v) depends, to the right of b, on the |v| symbols of v and on whether the boundary behind v was merged before:
by a rule r' < r whose left part is on the right spine of v's own merge tree, hence on the symbols of its right part, and so
on. The longest chain |v| + |v'| + |v''| + ... with falling ranks is therefore a sufficient lookahead L. One pass over the
merge list computes it. Symbols that end more than L symbols before the end of what was read are final whatever follows; since
no merge crosses a final boundary, what follows it is merged on its own. A run of any length thus needs a buffer of fixed size.

**Around it.** Special tokens are found in the raw text, the rest is normalised in slices that end where normalisation cannot
look across, and cut into words by the tokenizer's pattern; an open run of letters or signs is carried from slice to slice.
Blank-separated words that occur often are looked up in a table of bounded bytes.

**Decoding.** Tokens become bytes; a machine with at most three pending bytes turns them into text, chunk by chunk. A tokenizer
without decoder joins its pieces by blanks as they are written, one with a byte-level decoder joins their bytes.

Defined cases: a null or empty text has no ids and decodes to an empty text; a null list of ids counts as empty; ids that
the vocabulary lacks decode to nothing; repeated rows are encoded each; an empty table gives no rows; `doc` holds the
kept columns, so no name can clash; very long texts and words pass in slices.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.tables import rows_of, texts_of, tidied

_WORDS = re.compile(r"[^ \t\n\r]+")
_ODD_BLANKS = re.compile("[\x1c-\x1f]")  # blanks for str.split, but not for the tokenizer
_BLANK = re.compile(r"[ \t\n\r]")
_WITH_SIGNS = re.compile(r"(.*[A-Za-z0-9])([.,;:!?|#$%&*]+)", re.DOTALL)  # always cut before these signs, and none begins a word with letters
_MASK, _NO_RULE = (1 << 20) - 1, 1 << 62
_SHORT, _ENTRY = 48, 200  # characters of words entered together; bytes that an entry of the table takes besides its word
WINDOW = 1 << 18  # characters of a text that are looked at together
SLICE = 2048  # characters of a long word that are normalised together


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the others
    follow from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=1)
def _second_parts() -> frozenset[str]:
    """Characters that a composition may take in as its second part."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


def stands_apart(char: str) -> bool:
    """Whether normalisation never looks from this character to the ones before it."""
    if char.isascii():
        return True
    return not unicodedata.combining(char) and unicodedata.category(char) != "Cn" and char not in _second_parts()


class Merges:
    """The merge list of a tokenizer file: symbols of bytes, rules by pair, and the lookahead that suffices."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.decoder = spec["model"], spec.get("decoder")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        prefix = model.get("continuing_subword_prefix") or ""
        # (left << 20 | right) -> (rank << 20 | made): one number orders rules by rank
        self.rules = {vocab[u] << 20 | vocab[v]: rank << 20 | vocab[u + v.removeprefix(prefix)] for rank, (u, v) in enumerate(pairs)}
        order = np.argsort(np.fromiter(self.rules, np.int64, len(self.rules)))
        self.pairs = np.fromiter(self.rules, np.int64, len(self.rules))[order]
        self.made = np.fromiter(self.rules.values(), np.int64, len(self.rules))[order]
        letters = byte_letters()
        self.plain = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        own = Tokenizer.from_file(path)
        self.normalise = own.normalizer.normalize_str if own.normalizer else str
        self.pattern = _pattern(spec["pre_tokenizer"])
        self.pieces = dict(vocab) | self.specials
        self.lookahead, self.longest = self._lookahead()

    def _lookahead(self) -> tuple[int, int]:
        length = dict.fromkeys(self.plain, 1) | dict.fromkeys(self.final, 1)
        right: dict[int, int] = {}
        behind: dict[int, int] = {}  # left part -> longest chain of the rules so far that begin with it
        most = 0
        for pair, rule in self.rules.items():  # by rank
            u, v, made = pair >> 20, pair & _MASK, rule & _MASK
            more, s = behind.get(v, 0), v
            while s in right:
                s = right[s]
                more = max(more, behind.get(s, 0))
            chain = length[v] + more
            behind[u] = max(behind.get(u, 0), chain)
            most = max(most, chain)
            if made in right:
                raise ValueError("two rules make the same symbol: ranks do not give an order of passes")
            right[made], length[made] = v, length[u] + length[v]
        return most, max(length.values())

    def merged_many(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many whole words at once (bytes of all, bytes of each), and the number of ids of each. All words take
        their lowest rule in step; runs of overlapping places merge every second pair, from the left."""
        ends = np.cumsum(sizes)
        symbols, word = np.array(self.plain)[data], np.repeat(np.arange(len(sizes)), sizes)
        symbols[ends - 1] = np.array(self.final)[data[ends - 1]]
        inside = word[1:] == word[:-1]
        rules = np.full(len(symbols), _NO_RULE)  # of each symbol with its right neighbour
        rules[:-1][inside] = self._rules_of(symbols[:-1][inside], symbols[1:][inside])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rules, starts), lengths)
            ready = lowest == _NO_RULE
            if ready.any():
                done.append((word[ready], symbols[ready]))
                symbols, word, rules, lowest = symbols[~ready], word[~ready], rules[~ready], lowest[~ready]
                if not len(symbols):
                    break
            at = np.flatnonzero(rules == lowest)
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            symbols[at] = rules[at] & _MASK
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbols, word, rules = symbols[keep], word[keep], rules[keep]
            again = np.zeros(len(word), bool)  # places whose pair is a new one
            again[at] = again[at[at > 0] - 1] = True
            rules[again] = _NO_RULE
            again = np.flatnonzero(again[:-1] & (word[1:] == word[:-1]))
            rules[again] = self._rules_of(symbols[again], symbols[again + 1])
        if not done:
            return np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
        word, symbols = (np.concatenate(c) for c in zip(*done))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def _rules_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.made[at], _NO_RULE)

    def merged(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """What merging by rank, then place, leaves of the symbols, and how many symbols each spans."""
        n, rule_of = len(symbols), self.rules.get
        if n < 64:
            symbols, spans = list(symbols), [1] * n
            rules = [rule_of(a << 20 | b, _NO_RULE) for a, b in zip(symbols, symbols[1:])]
            while rules and (rule := min(rules)) != _NO_RULE:
                i = rules.index(rule)
                made = symbols[i] = rule & _MASK
                spans[i] += spans.pop(i + 1)
                del symbols[i + 1], rules[i]
                if i:
                    rules[i - 1] = rule_of(symbols[i - 1] << 20 | made, _NO_RULE)
                if i < len(rules):
                    rules[i] = rule_of(made << 20 | symbols[i + 1], _NO_RULE)
            return symbols, spans
        alive, spans, after, before = list(symbols), [1] * n, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rule_of(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rule, i, j = heapq.heappop(heap)
            if alive[i] < 0 or after[i] != j or rule_of(alive[i] << 20 | alive[j]) != rule:
                continue
            made = rule & _MASK
            alive[i], alive[j], spans[i] = made, -1, spans[i] + spans[j]
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rule_of(made << 20 | alive[k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            h = before[i]
            if h >= 0 and (r := rule_of(alive[h] << 20 | made)) is not None:
                heapq.heappush(heap, (r, h, i))
        left = [i for i in range(n) if alive[i] >= 0]
        return [alive[i] for i in left], [spans[i] for i in left]


class _Kinds(dict):
    """For str.translate: one letter, digit, blank or sign that stands for each character beyond ASCII, by the
    tokenizer library's own classes, which follow another edition of the character tables than `regex`."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.tests = [(Split(Regex(f"[{c}]"), "removed", invert=True), s) for c, s in ((r"\p{L}", "\u00e9"), (r"\p{N}", "\u00b2"), (r"\s", "\u3000"))]

    def __missing__(self, code: int) -> str:
        found = chr(code) if code < 128 else next((s for test, s in self.tests if test.pre_tokenize_str(chr(code))), "\u00a7")
        self[code] = found
        return found


class Pattern:
    """The pattern that cuts words out of normalised text."""

    def __init__(self, written: str):
        if set(re.findall(r"\\p\{\w+\}|\\\w", written)) - {r"\p{L}", r"\p{N}", r"\s"}:
            raise ValueError(f"unknown classes in {written}")
        self.kinds, self.words = _Kinds(), regex.compile(written)
        #: alternatives that take runs of any length
        self.runs = [regex.compile(a) for a in written.split("|") if a.endswith("]+")]

    def shape(self, text: str) -> str:
        return text if text.isascii() else text.translate(self.kinds)

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text)
        return [text[slice(*m.span())] for m in self.words.finditer(self.shape(text))]


def _pattern(spec: dict) -> Pattern:
    parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
    split = [p for p in parts if p["type"] == "Split"]
    level = [p for p in parts if p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"]]
    if len(split) != 1 or len(level) != 1 or len(parts) != 2 or split[0]["behavior"] != "Removed" or not split[0]["invert"]:
        raise ValueError("the streaming encoder needs a pattern that names the words, then byte-level symbols")
    return Pattern(split[0]["pattern"]["Regex"])


class RunStream:
    """One word that arrives in parts: ids come out as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.rest = merges, []
        self.full = 8 * (merges.lookahead + merges.longest)

    def push(self, part: str) -> list[int]:
        self.rest += map(self.merges.plain.__getitem__, part.encode())
        out: list[int] = []
        while len(self.rest) > self.full:  # the last symbol stays: it may turn out to end the word
            ids, spans = self.merges.merged(self.rest[: self.full])
            end = 0
            for symbol, span in zip(ids, spans, strict=True):
                if end + span > self.full - self.merges.lookahead:
                    break
                out.append(symbol)
                end += span
            self.rest = self.rest[end:]
        return out

    def finish(self, last: int) -> list[int]:
        """last: the last byte of the word."""
        self.rest[-1] = self.merges.final[last]
        ids, self.rest = self.merges.merged(self.rest)[0], []
        return ids


class Encoder(dict):
    """Ids (as little-endian uint32 bytes) of texts, chunk by chunk; as a dict, the bounded table of known words."""

    def __init__(self, merges: Merges, most_bytes: int = 48 << 20):
        self.merges, self.most_bytes, self.held = merges, most_bytes, 0

    def __missing__(self, word: str) -> bytes:
        if len(word) > SLICE:
            return b"".join(self.long_word(word))
        ids = self._short(word)
        self.held += _ENTRY + 2 * len(word) + len(ids)
        if self.held > self.most_bytes:
            self.clear()
            self.held = 0
        self[word] = ids
        return ids

    def learn(self, texts: list[str]) -> None:
        """Enter the short words of these texts into the table, all at once. Words the table lacks are encoded one by one."""
        words: set[str] = set()
        special, some = self.merges.special, False
        for text in texts:
            if not _ODD_BLANKS.search(text):
                words.update(text.split())
            some = some or bool(special and special.search(text))
        words = {w for w in words if w not in self and len(w) <= _SHORT}
        if some:
            words = {w for w in words if not special.search(w)}
        need = sum(map(len, words)) * 4 + _ENTRY * len(words)
        if self.held + need > self.most_bytes:
            self.clear()
            self.held = 0
            if need > self.most_bytes:
                return
        self._enter([w for w in words if w.isascii()])
        self._enter([w for w in words if not w.isascii()])

    def _enter(self, words: list[str]) -> None:
        text = self.merges.normalise(" ".join(words))
        shape, pattern = self.merges.pattern.shape(text), self.merges.pattern.words
        if not words or text.count(" ") != len(words) - 1:  # a character that only the tokenizer takes for a blank
            return
        spans = np.array([m.span() for m in pattern.finditer(shape)], np.int64).reshape(-1, 2)
        data = np.frombuffer(text.encode(), np.uint8)
        lead = (data & 0xC0) != 0x80
        place = np.append(np.flatnonzero(lead), len(data))  # byte of each character
        starts, ends = place[spans[:, 0]], place[spans[:, 1]]
        word = np.searchsorted(np.flatnonzero(data == 0x20), starts)
        used = np.zeros(len(data) + 1, np.int64)
        np.add.at(used, starts, 1)
        np.add.at(used, ends, -1)
        ids, counts = self.merges.merged_many(data[np.cumsum(used)[:-1] > 0], ends - starts)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(word, counts, len(words)).astype(np.int64))]) * 4
        packed = ids.astype("<u4").tobytes()
        for w, low, high in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self[w] = packed[low:high]
            self.held += _ENTRY + 2 * len(w) + high - low

    def _parts(self, word: str) -> Iterator[tuple[int, int, int | None]]:
        """Start and end of the parts of a word, and the id of a part that is a special token."""
        at = 0
        if self.merges.special is not None:
            for m in self.merges.special.finditer(word):
                yield at, m.start(), None
                yield m.start(), m.end(), self.merges.specials[m[0]]
                at = m.end()
        yield at, len(word), None

    def _run(self, run: str) -> list[int]:
        m, data = self.merges, run.encode()
        return m.merged([*map(m.plain.__getitem__, data[:-1]), m.final[data[-1]]])[0]

    def _short(self, word: str) -> bytes:
        if not (self.merges.special and self.merges.special.search(word)):
            parts = _WITH_SIGNS.fullmatch(word)
            if parts:
                return self[parts[1]] + self[parts[2]]
            if word.isascii():
                if word != (low := self.merges.normalise(word)):
                    return self[low]
                if word.isalpha():
                    return self._packed(self._run(word))
        ids: list[int] = []
        for low, high, special in self._parts(word):
            if special is not None:
                ids.append(special)
            elif low < high:
                for run in self.merges.pattern.cut(self.merges.normalise(word[low:high])):
                    ids += self._run(run)
        return self._packed(ids)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def long_word(self, word: str) -> Iterator[bytes]:
        for low, high, special in self._parts(word):
            for ids in [[special]] if special is not None else self._slices(word, low, high):
                yield self._packed(ids)

    def _slices(self, word: str, low: int, high: int) -> Iterator[list[int]]:
        carry, stream, going, last, pattern = "", None, None, 0, self.merges.pattern
        while low < high:
            cut = min(low + SLICE, high)
            while cut < high and not stands_apart(word[cut]):
                cut += 1
            text, low = carry + self.merges.normalise(word[low:cut]), cut
            shape, carry, at = pattern.shape(text), "", 0
            if stream is not None:
                m = going.match(shape)
                at = m.end() if m else 0
                if at:
                    yield stream.push(text[:at])
                    last = text[at - 1].encode()[-1]
                if at == len(text):
                    continue
                yield stream.finish(last)
                stream = None
            for m in pattern.words.finditer(shape, at):
                if low < high and m.end() >= len(text) - 2:  # more may belong to it
                    carry = text[m.start() :]
                    break
                yield self._run(text[m.start() : m.end()])
            if len(carry) > SLICE:  # words of the pattern that are no runs are short
                going = next(p for p in pattern.runs if p.match(pattern.shape(carry)))
                stream, last = RunStream(self.merges), carry[-1].encode()[-1]
                yield stream.push(carry)
                carry = ""
        if stream is not None:
            yield stream.finish(last)
        for run in pattern.cut(carry):
            yield self._run(run)

    def chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a text, in chunks; between blanks nothing depends on what is beyond them."""
        at, end = 0, len(text)
        while at < end:
            stop = min(at + WINDOW, end)
            if stop < end:
                cut = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                if cut <= at:
                    m = _BLANK.search(text, stop)
                    cut = m.start() if m else end
                stop = cut
            part, at = text[at:stop], stop
            words = _WORDS.findall(part) if _ODD_BLANKS.search(part) else part.split()
            if len(part) > WINDOW:
                for word in words:
                    yield from self.long_word(word)
            else:
                yield b"".join(map(self.__getitem__, words))


class Decoder:
    """ids in, text out, chunk by chunk; holds at most three bytes of a character that is not complete."""

    def __init__(self, merges: Merges):
        kind = (merges.decoder or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder of kind {kind}")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        pieces = [b""] * (max(merges.pieces.values()) + 1)
        for piece, i in merges.pieces.items():
            if kind is None:
                pieces[i] = b" " + piece.encode()
            elif all(c in byte_of for c in piece) and piece not in merges.specials:
                pieces[i] = bytes(map(byte_of.__getitem__, piece))
            else:
                pieces[i] = piece.encode()
        self.joined, self.known = kind is None, len(pieces)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.cumsum([0, *map(len, pieces)])
        self.restart()

    def restart(self) -> None:
        self.machine, self.first = codecs.getincrementaldecoder("utf-8")("replace"), self.joined

    def feed(self, ids: np.ndarray) -> str:
        ids = ids[ids < self.known]
        sizes = self.offsets[ids + 1] - self.offsets[ids]
        starts = self.offsets[ids] - (np.cumsum(sizes) - sizes)
        made = self.data[np.repeat(starts, sizes) + np.arange(int(sizes.sum()))].tobytes()
        if self.first and made:
            made, self.first = made[1:], False  # no blank before the first piece
        return self.machine.decode(made)

    def end(self) -> str:
        return self.machine.decode(b"", True)

    def text(self, ids: np.ndarray, step: int = 1 << 16) -> str:
        self.restart()
        return "".join([*(self.feed(ids[i : i + step]) for i in range(0, len(ids), step)), self.end()])


@lru_cache(maxsize=1)
def merges_of(path: str) -> Merges:
    return Merges(path)


def _kept(df: DataFrame, keep: list[str]) -> str:
    return f"doc struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in df.select(*keep).schema)}>"


def encoded(docs: DataFrame, keep: list[str], *, tokenizer: str, text: str = "text") -> DataFrame:
    """doc (columns in keep), ids (little-endian unsigned 32-bit), n_tokens, for each row."""
    names = list(keep)
    inner = docs.select(F.struct(*dict.fromkeys([*keep, text])).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges_of(tokenizer))
        for batch in rows_of(batches):
            rows = batch.column(0)
            own = texts_of(rows.field(text)).to_pylist()
            encoder.learn([t for t in own if len(t) <= WINDOW])
            ids = [b"".join(encoder.chunks(t)) for t in own]
            doc = pa.StructArray.from_arrays([rows.field(n) for n in names], names=names)
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary()), counts], names=["doc", "ids", "n_tokens"])

    return inner.mapInArrow(tidied(run), f"{_kept(docs, names)}, ids binary, n_tokens bigint")


def decoded(coded: DataFrame, keep: list[str], *, tokenizer: str, ids: str = "ids") -> DataFrame:
    """doc (columns in keep), decoded (text), for each row."""
    names = list(keep)
    inner = coded.select(F.struct(*dict.fromkeys([*keep, ids])).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(merges_of(tokenizer))
        for batch in rows_of(batches):
            rows = batch.column(0)
            texts = [decoder.text(np.frombuffer(i.as_py() or b"", "<u4").astype(np.int64)) for i in rows.field(ids)]
            doc = pa.StructArray.from_arrays([rows.field(n) for n in names], names=names)
            yield pa.RecordBatch.from_arrays([doc, pa.array(texts, pa.string())], names=["doc", "decoded"])

    return inner.mapInArrow(tidied(run), f"{_kept(coded, names)}, decoded string")
