import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from packwise.llm import token_stream as ts
from packwise.llm.queries import QUERIES, word_tokenizer

SMALL = "/root/testdata/sf0.001"
PATH = word_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return ts.merges_of(PATH)


def _ids(encoder, text):
    return np.frombuffer(b"".join(encoder.chunks(text)), "<u4").tolist()


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_bpe_stream"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, library):
    texts = [None, "", " ", "a" * 40_000, "x <|endoftext|>y", "x <|endoftext|>y", "é" * 9000 + "!" * 9000 + "'s" * 4000]
    rows = [(None if t is None else i, t, "d", "i") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, ids string")
    coded = ts.encoded(docs, ["doc_id", "doc", "ids"], tokenizer=PATH).select("doc.doc_id", "ids", "n_tokens")
    back = ts.decoded(coded, ["doc_id", "ids"], tokenizer=PATH).collect()
    want = {None if t is None else i: t for i, t in enumerate(texts)}
    assert len(back) == len(texts)
    for r in back:
        ids = library.encode(want[r.doc.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.doc.ids), "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert ts.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), ["doc_id"], tokenizer=PATH).first().decoded == ""
    assert ts.encoded(docs.limit(0), ["doc_id"], tokenizer=PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_long_words_of_any_kind(library, merges, seed):
    rng = random.Random(seed)
    letters = ["abcdefghijklmnopqrstuvwxyz", "aab", "the ing er", "étéİ̧́ΑΣ日本語한국ᅡ", "'s've'!.,;0123<|endoftext|>", "̈́क़া"]
    encoder = ts.Encoder(merges, most_bytes=1 << 16)
    for _ in range(25):
        some = "".join(rng.sample(letters, rng.randint(1, 3)))
        size = rng.choice([5, 50, 3000, 9000])
        text = rng.choice(["".join(rng.choice(some) for _ in range(size)), rng.choice(["a", "!", "ab", "'", "é", "z'"]) * size])
        assert _ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, (seed, text[:40])


def test_all_characters_are_cut_as_by_the_library(library, merges):
    encoder = ts.Encoder(merges)
    codes = [*range(0x3100), *range(0xA000, 0xAC10), *range(0xF900, 0x10400), *range(0x11000, 0x12000), *range(0x1E000, 0x1F000, 7)]
    texts = [f"a{chr(c)}1{chr(c)}.{chr(c)}'S{chr(c)}{chr(c)} {chr(c)}" for c in codes if not 0xD800 <= c < 0xE000]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert _ids(encoder, text) == found.ids, ascii(text)


def _toy(tmp_path, pairs, letters="abc"):
    shown = ts.byte_letters()
    pieces = [*shown, *(c + "</w>" for c in shown), *("".join(p) for p in pairs)]
    spec = {
        "model": {"type": "BPE", "vocab": {p: i for i, p in enumerate(pieces)}, "merges": pairs, "end_of_word_suffix": "</w>"},
        "pre_tokenizer": json.load(open(PATH))["pre_tokenizer"], "normalizer": None, "decoder": None, "added_tokens": [],
    }
    path = tmp_path / "toy.json"
    path.write_text(json.dumps(spec))
    return ts.Merges(str(path))


def test_lookahead_suffices_for_every_continuation(tmp_path):
    """Whatever follows the lookahead, the tokens before it are those of the whole word."""
    m = _toy(tmp_path, [["b", "c"], ["a", "b"], ["a", "bc"], ["c", "a"], ["c", "c"], ["ab", "ca"]])
    assert m.lookahead == 4  # (ab, ca) needs "ca", whose last part a may go to (a, bc); no rule before that begins with bc or c

    def cuts(word):
        ids, spans = m.merged([m.plain[b] for b in word.encode()])
        return set(itertools.accumulate(spans))

    for start in itertools.product("abc", repeat=7):
        head = "".join(start)
        seen = [frozenset(x for x in cuts(head + "".join(tail)) if x <= len(head) - m.lookahead) for tail in itertools.product("abc", repeat=3)]
        assert len(set(seen)) == 1


def test_stream_in_small_parts_with_the_least_buffer(merges):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000))
    whole = merges.merged([*map(merges.plain.__getitem__, word[:-1].encode()), merges.final[ord(word[-1])]])[0]
    stream, out, most = ts.RunStream(merges), [], 0
    stream.full = merges.lookahead + merges.longest + 1
    for i in range(0, len(word), 50):
        out += stream.push(word[i : i + 50])
        most = max(most, len(stream.rest))
    assert out + stream.finish(ord(word[-1])) == whole and most <= stream.full + 50


def test_both_merging_ways_agree(merges):
    rng = random.Random(8)
    for _ in range(200):
        part = [merges.plain[b] for b in bytes(rng.choice(b"aeinrst") for _ in range(30))]
        short = merges.merged(part)[0]
        both = merges.merged(part + [merges.plain[0]] * 40)[0]  # long enough for the heap; byte 0 merges with no letter
        assert both[: len(short)] == short


def test_words_entered_together_equal_single_ones(library, merges):
    rng = random.Random(3)
    words = ["".join(rng.choice("aaabntheri'sé.!İ1") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    words += ["a" * 47, "<|endoftext|>x", "\u180e", "x\u180ey", "\u0301a", "...", "aa" * 20]
    for some in (words, words[:1], []):
        encoder = ts.Encoder(merges)
        encoder.learn([" ".join(some)])
        assert len(encoder) >= 0.9 * len(set(some)) - 5
        for w in some:
            assert _ids(encoder, w) == library.encode(w, add_special_tokens=False).ids, ascii(w)
    small = ts.Encoder(merges, most_bytes=5000)
    small.learn([" ".join(words)])
    assert not small and _ids(small, words[0]) == library.encode(words[0], add_special_tokens=False).ids


def test_decoding_machine_holds_open_characters(merges):
    spec = ts.Decoder(merges)
    spec.joined, spec.known = False, 4
    spec.data, spec.offsets = np.frombuffer("é日".encode() + b"\xff", np.uint8), np.array([0, 1, 3, 5, 6])
    spec.restart()
    assert [spec.feed(np.array([i])) for i in (0, 1, 2)] == ["", "é", "日"]
    spec.restart()
    assert spec.feed(np.array([3, 0])) + spec.end() == "��"
    assert spec.text(np.array([0, 9, 1, 2])) == "é日"  # an unknown id decodes to nothing
