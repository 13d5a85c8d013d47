import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from packwise.llm import packing
from packwise.llm.queries import QUERIES, word_tokenizer
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def _packed_right(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_query_returns_every_token_once(spark):
    tokenizer = Tokenizer.from_file(word_tokenizer())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_best_fit_packing"](spark, SMALL).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == docs.keys()
    for doc_id, own in pieces.items():
        ids, at = brute.token_ids(tokenizer, docs[doc_id]), 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, brute.crc(ids[at : at + r.length]))
            at += r.length
            assert r.length == 2048 or at == len(ids)
        assert at == len(ids)
    used = _packed_right(rows, 2048)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(spark):
    rows = [(1, None, 7), (1, None, 7), (2, "", None), (3, "a" * 3000 + " b" * 5000, 1), (4, "\x1c x y z <|endoftext|> É", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    tokenizer = Tokenizer.from_file(word_tokenizer())
    pieces = packing.token_pieces(docs, ["doc_id", "piece"], tokenizer=word_tokenizer(), with_ids=True)
    got = defaultdict(list)
    for r in pieces.orderBy("piece").collect():
        got[r.doc.doc_id].append(list(r.ids))
    assert got[1] == [[0], [0]] and got[2] == [[0]]
    for i, text in ((3, rows[3][1]), (4, rows[4][1])):
        assert sum(got[i], []) == brute.token_ids(tokenizer, text)
    packed = packing.pack(pieces.select("doc.doc_id", "piece", "length")).collect()
    assert _packed_right(packed, 2048) == -(-sum(r.length for r in packed) // 2048)
    assert packing.pack(pieces.select("piece", "length").limit(0)).count() == 0


def test_partitions_with_a_gap_exchange(spark):
    lengths = [int(x) for x in np.random.default_rng(3).integers(1, 60, 3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i long, length long")
    apart = packing.pack(pieces, capacity=100, part_size=100, rounds=0).collect()
    joined = packing.pack(pieces, capacity=100, part_size=100, rounds=None).collect()
    assert sorted((r.i, r.length) for r in joined) == list(enumerate(lengths))
    assert _packed_right(joined, 100) < _packed_right(apart, 100)
    assert _packed_right(joined, 100) >= packing.sequences_needed(pieces, 100)


@pytest.mark.parametrize("seed", range(6))
def test_bound_never_exceeds_best_fit(seed):
    lengths = np.random.default_rng(seed).integers(1, 101, 200)
    histogram = np.bincount(lengths, minlength=101)
    assert packing.lower_bound(histogram, 100) <= packing.best_fit_decreasing(lengths, 100)[2]
    assert packing.lower_bound(np.bincount([51] * 9, minlength=101), 100) == 9


def test_words_are_cut_where_the_tokenizer_cuts():
    tokenizer = Tokenizer.from_file(word_tokenizer())
    known = packing.WordIds(word_tokenizer(), most_bytes=20_000)
    blanks = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
    words = ["abc", "Élan", "x1y22", "don't,", "it's!", "a.b.", "e\u0301,", "ÜBER!!", "###", "İΣ.", "_a_.", "\u0301x"]
    texts = [f"{w}{b}{v}{b}" for w in words for v in words for b in blanks]
    for text in texts:
        assert np.frombuffer(known.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_marks_behind_letters_that_end_in_a_mark_when_normalised():
    tokenizer = Tokenizer.from_file(word_tokenizer())
    known = packing.WordIds(word_tokenizer())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    odd = [c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1:].isalnum()]
    assert len(odd) > 30
    texts = ["D\u0130YARBAKIRL\u0130.", *(f"x{c}." for c in odd), *(f"{c}.;" for c in letters[::23])]
    for text in texts:
        assert np.frombuffer(known.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_certified_parts_that_waste_together_exchange(spark):
    """Parts of about 9 pieces meet their own bounds with a bin that is not full; together they need fewer."""
    pieces = spark.createDataFrame([(i, 25) for i in range(400)], "i long, length long")
    packed = packing.pack(pieces, capacity=100, part_size=9).collect()
    assert _packed_right(packed, 100) == 100 and all(r.certified for r in packed)


def test_a_worker_tokenizes_a_word_once():
    """Tasks of one worker share the ids of words; a task of another function frees them."""
    from packwise.llm import tables

    made = []

    def words():
        made.append({})
        return made[-1]

    def task(batches):
        known = tables.held("ids", words)
        for batch in batches:
            known.setdefault(batch, len(known))
            yield batch, len(known)

    run = tables.tidied(task, holds="ids")
    assert list(run(iter("ab"))) == [("a", 1), ("b", 2)]
    assert list(run(iter("ac"))) == [("a", 2), ("c", 3)] and len(made) == 1
    list(tables.tidied(lambda batches: batches)(iter("x")))
    assert list(run(iter("a"))) == [("a", 1)] and len(made) == 2


def test_words_tokenized_together_have_their_own_ids():
    """New words are tokenized many in a call, also beside words that hold the mark between them, accents and very long words."""
    import public_tokenizers
    from packwise.llm.packing import WordIds

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Plain words, rÉéaux? ? ?? a?b ?! 12.50 x@y.org don't “q” ½ẞİ ét́ ﬁne " + "long" * 40 + " " + " ".join(f"word{i}" for i in range(200))
    alone, together, calls = WordIds(path), WordIds(path), []
    encode = together.encode
    together.encode = lambda words, **k: calls.append(words) or encode(words, **k)
    together.learn([together.split(text)])
    assert together.ids(text) == alone.ids(text) == np.array(encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(calls) < 60


def test_words_of_letters_need_no_call_that_normalises():
    """Words of Latin letters go to the model alone; a table that forgets keeps the words it met again."""
    tokenizer = Tokenizer.from_file(word_tokenizer())
    known, calls = packing.WordIds(word_tokenizer(), most_bytes=20_000), []
    encode = known.encode
    known.encode = lambda words, **k: calls.append(words) or encode(words, **k)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    words = [f"{a}{b}{c}" for a in letters for b in ("", "e", "\u00df") for c in ("", ",", "?!")]
    for word in words:
        assert np.frombuffer(known.ids(word), "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids, ascii(word)
    calls.clear()
    known.learn([["Other,", "words", "\u00c9lan!", "words"]])
    known.ids("Other, words \u00c9lan words")
    assert not calls
    for i in range(300):
        known.ids(f"12x seen{i}")
    assert sum("12x" in c for c in calls) == 1
    assert len(known) + len(known.older) < 120
