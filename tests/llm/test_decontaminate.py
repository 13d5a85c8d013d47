from packwise.llm import decontaminate
from packwise.llm.queries import QUERIES
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def _both(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    import hashlib

    got = decontaminate.contamination(d, i, ["doc_id"], **options).collect()
    return {
        (r.doc.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
        for r in got
    }


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op10_benchmark_decontamination"](spark, SMALL).collect()}
    expected = brute.contamination(docs, items)
    assert got == expected and any(r[5] for r in expected)


def test_odd_rows_and_blocks(spark):
    many = " ".join(f"w{i}" for i in range(40))
    items = [(1, "one two"), (1, "one two"), (2, many), (3, None), (4, ""), (5, "..."), (6, many + " tail"), (7, "same " * 20), (None, "x")]
    docs = [
        (1, None), (2, ""), (3, "One, two!"), (4, "one"), (5, "a " * 100 + many.upper() + " b" * 100), (6, many[:60]), (7, "same " * 500),
        (8, " ".join(f"w{i}" for i in range(5, 17))), (9, " ".join(f"w{i}" for i in range(5, 18))), (9, "one two"), (10, "é" * 50_000),
    ]
    expected = brute.contamination(docs, [i for i in items if i[0] is not None])
    assert _both(spark, docs, items) == expected
    assert _both(spark, docs, items, block=8) == expected  # several passes
    assert all(r[2] == 0 for r in _both(spark, docs, []))
    assert _both(spark, [], items) == set()


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("one two", 5, "x")], "text string, n_words int, spans string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    row = decontaminate.contamination(docs, items, ["n_words", "spans"]).first()
    assert (row.doc.n_words, row.doc.spans, row.n_words, row.spans, row.contaminated) == (5, "x", 2, [0, 2], True)
