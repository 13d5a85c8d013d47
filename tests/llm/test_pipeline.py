from collections import Counter

import corpus_pipeline
from packwise.llm import personal_data
from packwise.llm.queries import word_tokenizer
from packwise.llm.tables import read, staged
from tests.llm import brute
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = read(spark, SMALL, "documents")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in read(spark, SMALL, "labels").collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SMALL)))
    assert all(s.columns == columns for s in seen[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in seen[:-1]]
    clean = [i for i in rows[0] if labels.get(i) == 1]
    assert sum(i in rows[1] for i in clean) > 0.97 * len(clean)
    texts = [(i, r.text) for i, r in rows[1].items()]
    assert set(rows[2]) == {c for _, _, c in brute.near_duplicates(texts)}
    items = [tuple(r) for r in read(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination([(i, r.text) for i, r in rows[2].items()], items) if r[5]}
    assert set(rows[3]) == set(rows[2]) - dirty and dirty
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not any(personal_data.base_spans(r.text).values()) and r.n_chars == len(r.text)
        if not any(personal_data.base_spans(rows[3][i].text).values()):
            assert r.text == rows[3][i].text or "[" in r.text
    tokenizer = Tokenizer.from_file(word_tokenizer())
    sizes = Counter()
    for r in seen[-1].collect():
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(brute.token_ids(tokenizer, r.text)) for i, r in rows[4].items()}


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "abc", "en", "s", 3), (3, "a b c", "en", None, 5), (4, "A b C", "en", "s", 5)]
    docs = spark.createDataFrame(rows, read(spark, SMALL, "documents").schema)
    kept = corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 2, 3]
    for _, stage in corpus_pipeline.STAGES[2:]:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 6


def test_a_stage_has_one_python_worker_a_task(spark):
    """Chained workers of one task hold their batches beside each other."""
    docs = spark.createDataFrame([(1, "one two, a@b.example", "en", "s", 7)], read(spark, SMALL, "documents").schema)
    for stage in (corpus_pipeline.not_contaminated, corpus_pipeline.without_personal_data):
        plan = stage(spark, docs, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
