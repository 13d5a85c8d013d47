"""Words of whole batches of texts as numpy arrays: positions and 64-bit hashes, without a Python step per word.

Texts are read as UTF-8 bytes. Every separator of the two word classes used here is an ASCII byte and A-Z are the only
letters that change, so working on bytes equals working on characters.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_PIECE = 1 << 20  # bytes hashed at a time; longer words are hashed one by one
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word classes by byte, after A-Z are lower-cased.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(_PIECE, base, np.uint64)])) for base in (_BASE, _BASE_INVERSE)
        )


@dataclass
class Words:
    """data: lower-cased bytes; starts, ends: byte positions of words; hashes; first: index of each text's first word
    (one entry more than texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def spelled(self, index: int) -> bytes:
        return self.data[self.starts[index] : self.ends[index]].tobytes()


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    power, inverse = _powers()
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            stop = int(np.searchsorted(ends, low + _PIECE, "right"))
            if stop <= at:  # a word longer than a piece
                out[at] = int.from_bytes(hashlib.blake2b(data[low : ends[at]].tobytes(), digest_size=8).digest(), "little")
                at += 1
                continue
            span = data[low : ends[stop - 1]]
            sums = np.empty(len(span) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_VALUES[span] * power[: len(span)], out=sums[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = stop
    return out


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    """Words of every text; kind is NOT_BLANK or LETTERS_DIGITS."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, starts, ends, _hash_words(data, starts, ends), np.searchsorted(starts, bounds))


@lru_cache(maxsize=64)
def _factors(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7 + width)).integers(1, 1 << 63, width, dtype=np.uint64) * 2 + 1


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words, by its first word (runs may cross texts: the caller masks those)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(width))
        for k, factor in enumerate(_factors(width)):
            total += hashes[k : k + n] * factor
        return mix(total)


def run_of(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole sequence, equal to `runs` of that width."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.uint64(len(hashes)) + (hashes * _factors(len(hashes))).sum(dtype=np.uint64)]))[0]


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct runs of `width` words of each text; a shorter text gives its whole sequence, or nothing."""
    all_runs, out = runs(words.hashes, width), []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if high - low >= width:
            out.append(np.unique(all_runs[low : high - width + 1]))
        elif high > low:
            out.append(np.array([run_of(words.hashes[low:high])], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out
