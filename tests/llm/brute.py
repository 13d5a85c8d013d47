"""Plain, slow versions of the operators' contracts, used on small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text: str | None) -> list[bytes]:
    return WORD.findall(lower(text))


def contamination(docs: list[tuple], items: list[tuple], width: int = 13) -> set[tuple]:
    cut = []
    for name, text in items:
        w = LETTERS.findall(lower(text))
        if w:
            size = min(width, len(w))
            cut += [(name, tuple(w[i : i + size])) for i in range(len(w) - size + 1)]
    out = set()
    for doc_id, text in docs:
        w = LETTERS.findall(lower(text))
        places: dict[tuple, list[int]] = {}
        for size in {len(c) for _, c in cut}:
            for i in range(len(w) - size + 1):
                places.setdefault(tuple(w[i : i + size]), []).append(i)
        hit, found = set(), set()
        for name, c in cut:
            for i in places.get(c, ()):
                found.add(str(name))
                hit.update(range(i, i + len(c)))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.add((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def near_duplicates(docs: list[tuple], percent: int = 75) -> set[tuple]:
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {(i, len(s), root(i)) for i, s in sets}


def token_ids(tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
