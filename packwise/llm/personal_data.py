"""Personal data in texts: exact base patterns, and a semi-Markov conditional random field for what they miss.

Base spans follow fixed patterns (email, ip, card, phone), leftmost and non-overlapping per kind. The random field scores
whole candidate segments with features of the segment and its neighbours; a dynamic program over candidate segments of
bounded length chooses boundaries and types together. It is trained here, by gradient steps on a bounded sample of texts
(`sample` rows with the smallest hash): base spans are the labels, and altered copies of them (other separators, spelt-out
signs) teach it forms that the patterns miss. Text without candidates scores nothing, so time is spent only around
digits, `@` and spelt-out signs. Base spans always stay; added spans never overlap them.

Defined cases: null is the empty text; repeated rows are handled each; an empty table or one without personal data trains
on the built-in examples alone; positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.llm.tables import annotated, smallest

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, which is linear where the plain pattern is not."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > free and text[low - 1] in _LOCAL:
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            out.append((low, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    ips = [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    cards, phones = [], []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                cards.append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            phones.append(m.span())
    return {"email": _emails(text), "ip": ips, "card": cards, "phone": phones}


# --- segments and features -------------------------------------------------------------------------------------------

#: Starts of clusters worth a search; everything else is outside of any segment.
_TRIGGER = re.compile(r"[0-9]{2}|@|[\[({](?i:at)[\])}]| (?i:dot) ")
_UNIT = re.compile(r"[^\W_]+|[^\w\s]|_")
_AT = frozenset(["@", "at"])
MOST_UNITS = 14  # units of the longest segment
MOST_DIGITS = 20  # digits of the longest
_REACH = 60  # characters around a trigger
_CLUSTER = 400  # units whose segments are listed and scored at a time; the dynamic program goes on over whole runs


@lru_cache(maxsize=1 << 16)
def _shape(unit: str) -> str:
    if unit.isdigit():
        return f"n{min(len(unit), 6)}"
    if unit.isalpha():
        return "at" if unit.lower() == "at" else "dot" if unit.lower() == "dot" else "w"
    return "m" if len(unit) > 1 else unit


def segment_slots(units: list[tuple[str, int, int]], i: int, j: int, text: str) -> tuple[int, ...]:
    """Feature slots of the segment of units i..j-1 as a whole, with what stands before and after it."""
    before = _shape(units[i - 1][0]) if i and units[i - 1][2] == units[i][1] else "_"
    after = _shape(units[j][0]) if j < len(units) and units[j][1] == units[j - 1][2] else "_"
    goes_on = j < len(units) and units[j][0].lower() in ("at", "dot")
    began = i > 0 and units[i - 1][0].lower() in ("at", "dot")
    return _segment_slots(text[units[i][1] : units[j - 1][2]], before, after, goes_on, began)


@lru_cache(maxsize=1 << 15)
def _segment_slots(raw: str, before: str, after: str, goes_on: bool, began: bool) -> tuple[int, ...]:
    inner = _UNIT.findall(raw)
    shapes = [_shape(u) for u in inner]
    numbers = [u for u in inner if u.isdigit()]
    digits = sum(map(len, numbers))
    marks = "".join(sorted({u for u in inner if not u[0].isalnum()}))
    out = [
        f"first={shapes[0]}", f"last={shapes[-1]}", f"before={before}", f"after={after}", f"marks={marks[:6]}", f"digits={min(digits, 20)}",
        f"numbers={len(numbers)}", f"gaps={min(raw.count(' '), 6)}", f"signs={sum(u in _AT for u in map(str.lower, inner))}",
        f"dots={sum(u == '.' or u.lower() == 'dot' for u in inner)}", f"words={min(sum(s in ('w', 'm') for s in shapes), 6)}",
    ]
    out += ["goes on"] * goes_on + ["began before"] * began
    if len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers):
        out.append("octets")
    if digits >= 12 and _luhn("".join(numbers)):
        out.append("luhn")
    if len(inner) <= 9:
        out.append("shape=" + " ".join(shapes))
    return tuple(map(_slot, out))


def clusters(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of units around triggers; segments never leave a run."""
    low = high = -1
    for m in _TRIGGER.finditer(text):
        if m.start() > high:
            if high >= 0:
                yield from _cut(text, low, high)
            low = max(0, high, m.start() - _REACH)
        high = min(len(text), m.end() + _REACH)
    if high >= 0:
        yield from _cut(text, low, high)


def _cut(text: str, low: int, high: int) -> Iterator[list[tuple[str, int, int]]]:
    floor = max(0, low - _REACH)  # a word longer than that is taken from its middle
    while low > floor and text[low - 1].isalnum():
        low -= 1
    yield [(m[0], *m.span()) for m in _UNIT.finditer(text, low, high)]


def candidates(units: list[tuple[str, int, int]], text: str) -> list[tuple[int, int]]:
    return [segment for block in candidate_blocks(units, text) for segment in block]


def candidate_blocks(units: list[tuple[str, int, int]], text: str) -> Iterator[list[tuple[int, int]]]:
    """By start, in blocks of _CLUSTER starts: segments that could be personal data: digits or a sign inside, on one line, no wide gap, at most MOST_UNITS units."""
    lines = {a for _, a, _ in units if a and text[a - 1] == "\n"}
    digits = [len(u) if u.isdigit() else 0 for u, _, _ in units]
    signs_at = [k for k, (u, _, _) in enumerate(units) if u.lower() == "dot"]
    near_dot = np.zeros(len(units), bool)  # a spelt-out dot within _CLUSTER units
    for k in signs_at:
        near_dot[max(0, k - _CLUSTER) : k + _CLUSTER] = True
    spelt = near_dot.tolist()
    sign = [u == "@" or (u.lower() == "at" and (spelt[k] or (k > 0 and units[k - 1][0] in "[({"))) for k, (u, _, _) in enumerate(units)]
    hot = [d >= 2 or s for d, s in zip(digits, sign, strict=True)]
    out = []
    for i, (unit, _, _) in enumerate(units):
        if i % _CLUSTER == 0 and out:
            yield out
            out = []
        if not (unit[0].isalnum() or unit in "+(["):
            continue
        total = signs = 0
        for j in range(i + 1, min(len(units), i + MOST_UNITS) + 1):
            if j - 1 > i and units[j - 1][1] - units[j - 2][2] > 1 or units[j - 1][1] in lines and j - 1 > i:
                break
            total, signs = total + digits[j - 1], signs + sign[j - 1]
            if total > MOST_DIGITS:
                break
            if (total >= 7 or signs == 1) and units[j - 1][0][-1].isalnum() and (j - i > 1 or total >= 12) and any(hot[i:j]):
                out.append((i, j))
    if out:
        yield out


# --- the model -------------------------------------------------------------------------------------------------------

_SLOTS = 1 << 14


@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % _SLOTS


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.exp(np.array(values) - top).sum()))


def _best(n: int, useful: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The highest-scoring non-overlapping (start, end, kind) of segments (start, end, kind, score) above 0."""
    ends: dict[int, list[int]] = {}
    for k, (_, j, _, _) in enumerate(useful):
        ends.setdefault(j, []).append(k)
    value, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for k in ends.get(j, ()):
            v = value[useful[k][0]] + useful[k][3]
            if v > value[j]:
                value[j], back[j] = v, k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append(useful[back[j]][:3])
            j = useful[back[j]][0]
    return out[::-1]


class Field:
    """weights: (kinds, feature slots). A segment of a kind scores the sum of its features; units outside score 0."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = -2.0):
        self.weights, self.bias = np.zeros((len(KINDS), _SLOTS), np.float32) if weights is None else weights, bias

    def scores(self, slots: list[tuple[int, ...]]) -> np.ndarray:
        return np.array([self.weights[:, list(s)].sum(1) for s in slots], float).reshape(-1, len(KINDS)) + self.bias

    def best(self, n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """The highest-scoring set of non-overlapping segments with types."""
        kind, top = scores.argmax(1), scores.max(1)
        return _best(n, [(*segments[k], int(kind[k]), float(top[k])) for k in np.flatnonzero(top > 0).tolist()])

    def expected(self, n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        """Probability of each (segment, kind), by sums over all segmentations."""
        starts: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}
        inner = [_log_sum(list(s)) for s in scores]
        for k, (i, j) in enumerate(segments):
            starts.setdefault(i, []).append(k)
            ends.setdefault(j, []).append(k)
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[segments[k][0]] + inner[k] for k in ends.get(j, ()))])
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[segments[k][1]] + inner[k] for k in starts.get(i, ()))])
        outer = np.array([forward[i] + backward[j] for i, j in segments]) - forward[n]
        return np.exp(scores + outer[:, None])

    def fit(self, examples: list, epochs: int = 6, rate: float = 0.3) -> Field:
        """examples: (units, segments, slots, gold {segment index: kind}); adaptive gradient steps on the likelihood."""
        seen = np.full(self.weights.shape, 1e-2, np.float32)
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for e in rng.permutation(len(examples)):
                units, segments, slots, gold = examples[e]
                p = -self.expected(len(units), segments, self.scores(slots))
                for k, kind in gold.items():
                    p[k, kind] += 1
                for k in np.flatnonzero(np.abs(p).max(1) > 1e-3).tolist():
                    g = p[k][:, None]
                    at = list(slots[k])
                    seen[:, at] += g * g
                    self.weights[:, at] += rate * g / np.sqrt(seen[:, at])
        return self

    def added(self, text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        taken = sorted(s for spans in base.values() for s in spans)
        starts = np.array([a for a, _ in taken], np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
        out = []
        for units in clusters(text):
            useful = []
            for segments in candidate_blocks(units, text):
                if taken:  # no span that starts before the segment's end goes beyond its start
                    before = np.searchsorted(starts, [units[j - 1][2] for _, j in segments])
                    segments = [s for s, k in zip(segments, before.tolist(), strict=True) if not k or reach[k - 1] <= units[s[0]][1]]
                if segments:
                    scores = self.scores([segment_slots(units, i, j, text) for i, j in segments])
                    kind, top = scores.argmax(1), scores.max(1)
                    useful += [(*segments[k], int(kind[k]), float(top[k])) for k in np.flatnonzero(top > 0).tolist()]
            out += [(KINDS[kind], units[i][1], units[j - 1][2]) for i, j, kind in _best(len(units), useful)]
        return out


#: Forms that the base patterns miss; d stands for a digit.
_ALTERED = {
    "email": lambda s: [s.replace("@", " at ").replace(".", " dot "), s.replace("@", " [at] "), s.replace("@", "(at)"), s.replace("@", " @ ")],
    "ip": lambda s: [s.replace(".", " dot "), s.replace(".", "[.]")],
    "card": lambda s: [".".join(re.findall("....", _NOT_DIGIT.sub("", s))), "/".join(re.findall("....", _NOT_DIGIT.sub("", s)))],
    "phone": lambda s: [s.lstrip("+"), "00" + s.lstrip("+"), s.replace(" ", "/")],
}
_EXAMPLES = [
    ("email", "jane.roe@mail.example.com"), ("email", "k_12@example.org"), ("email", "ann@example.net"), ("email", "maria.garcia@site.example.org"),
    ("email", "j.d@mail.example"), ("email", "info.desk@example.com"), ("email", "tom.b7@a.example.com"), ("email", "sales@shop.example"), ("ip", "10.20.30.40"), ("ip", "192.168.1.254"), ("card", "4111 1111 1111 1111"),
    ("card", "5500000000000004"), ("phone", "+1 (212) 555-0100"), ("phone", "+49 30 5550 1234"),
]
_PLAIN = [
    "version 2026.12.01 of 17.10.2025 at 12:30", "items 100 200 300 400 and 1000000", "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"", "look at the dot",
    "he was at home and she at work", "meet at noon in the dot room", "at that time a dot. com", "stay at sea or at rest",
    "a dot at the end dot", "we met at 12 dot 30",
    "id 20260101120000 page 12 of 340", "password=8f363cbd09693ef8f7", "pi is 3.14159265358979", "a - b at c. d", "sha 5e71cd2b7c08d8c9ac", "1234567890",
]


def _example(text: str, gold: list[tuple[str, int, int]]) -> list:
    out = []
    for units in clusters(text):
        segments = candidates(units, text)
        index = {(units[i][1], units[j - 1][2]): k for k, (i, j) in enumerate(segments)}
        if segments:
            right = {index[(a, b)]: KINDS.index(kind) for kind, a, b in gold if (a, b) in index}
            out.append((units, segments, [segment_slots(units, i, j, text) for i, j in segments], right))
    return out


def train(docs: DataFrame, text: str, sample: int = 400, most_chars: int = 20_000, altered: int = 20) -> Field:
    """Fit on the `sample` texts with digits or @ that have the smallest hash (ties by text), of longer texts a window of `most_chars`
    characters at a place drawn by the hash, and of each text `altered` drawn spans in altered form: a bounded sample for learning
    only; searching covers whole texts."""
    given = docs.where(F.col(text).rlike("[0-9]{2}|@")).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    place = F.pmod(F.shiftright("h", 16), F.greatest(F.length("t") - most_chars + 1, F.lit(1)).cast("long")).cast("int")
    rows = smallest(given.select("h", F.substring("t", place + 1, F.lit(most_chars)).alias("t")), ["h", "t"], sample).collect()
    rng, examples = np.random.default_rng(3), []
    for t in [r.t for r in rows] + _PLAIN * 4:
        spans = base_spans(t)
        gold = [(k, a, b) for k, own in spans.items() for a, b in own]
        examples += _example(t, gold)
        for kind, a, b in [gold[i] for i in rng.permutation(len(gold))[:altered]]:
            forms = _ALTERED[kind](t[a:b])
            form = forms[int(rng.integers(len(forms)))]
            before, after = t[max(0, a - 40) : a], t[b : b + 40]
            examples += _example(before + form + after, [(kind, len(before), len(before) + len(form))])
    for kind, value in _EXAMPLES:
        for form in [value, *_ALTERED[kind](value)]:
            for before, after in (("the text of ", " and more"), ("", ""), ("at ", ". then")):
                examples += _example(before + form + after, [(kind, len(before), len(before) + len(form))])
    return Field().fit(examples)


def found(docs: DataFrame, keep: list[str], *, text: str = "text", field: Field | None = None) -> DataFrame:
    """`doc` (columns in keep) with base and added spans of every row, as arrays of (kind, start, end)."""
    field = field or train(docs, text)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def search(texts: pa.Array) -> dict[str, pa.Array]:
        base, added = [], []
        for value in texts.to_pylist():
            spans = base_spans(value)
            base.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in spans[k]])
            added.append([{"kind": k, "start": a, "end": b} for k, a, b in field.added(value, spans)])
        return {"base": pa.array(base, pa.list_(span)), "added": pa.array(added, pa.list_(span))}

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return annotated(docs, text, keep, f"base {kind}, added {kind}", search, _shape, _segment_slots, _slot)


def redacted(docs: DataFrame, columns: list[str], *, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """The rows with every span replaced by a mark such as [EMAIL]; other columns stay."""
    kinds, field = {k: mark.format(k.upper()) for k in KINDS}, train(docs, text)

    def clean(texts: pa.Array) -> dict[str, pa.Array]:  # found and replaced by one worker
        out = []
        for value in texts.to_pylist():
            at, parts = 0, []
            base = base_spans(value)
            spans = [(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, k) for k, a, b in field.added(value, base)]
            for a, b, kind in sorted(spans):
                if b > at:  # spans of different kinds may overlap
                    parts += [value[at : max(at, a)], kinds[kind] if a >= at else ""]
                    at = b
            out.append("".join([*parts, value[at:]]))
        return {"clean": pa.array(out, pa.string())}

    keyed = docs.select(F.col(text).isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != text], F.col(text).alias("t"))
    made = annotated(keyed, "t", [c for c in keyed.columns if c != "t"], "clean string", clean, _shape, _segment_slots, _slot)
    return made.select(
        *[F.when(~F.col("doc.none"), F.col("clean")).alias(c) if c == text else F.col(f"doc.c{i}").alias(c) for i, c in enumerate(columns)]
    )
