"""The registered queries of these operators: each applies one to its whole table and returns the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwise.llm import byte_cnn, decontaminate, hard_negatives, licences, near_copies, packing, personal_data, pitman_yor, token_stream, url_rules, vector_codes, voronoi_knn, warc
from packwise.llm.tables import crc_bucket, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"), ["doc_id"], tokenizer=word_tokenizer(), table_bytes=192 << 20)
    packed = packing.pack(pieces.select("doc.doc_id", "piece", "start", "length", "ids_crc32"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return judged.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op8_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scores = pitman_yor.scored(docs, F.coalesce(crc_bucket(F.col("doc_id"), 7) == 2, F.lit(False)), ["doc_id"])
    return scores.select("doc.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Fixed rules of the query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judged(read(spark, sf_dir, "pages").select("page_id", "url"), "url", rules)
    return judged.select("doc.page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
SQL["op2_url_rules"] = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest
), named AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM parts
), rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM (SELECT DISTINCT page_id, host, path FROM named) n
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM named n LEFT JOIN (SELECT * FROM fits WHERE place = 1) f ON n.page_id = f.page_id
"""


def _joined(spans: str):
    """kind:start:end of spans by kind as listed, then start."""
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in personal_data.KINDS]), s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind")),
        )
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data.found(read(spark, sf_dir, "documents"), ["doc_id"])
    spans = spans.withColumn("every", F.concat("base", "added"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in personal_data.KINDS]
    return spans.select("doc.doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("every").alias("spans"))


def quality_net(spark: SparkSession, sf_dir: str, docs: DataFrame) -> byte_cnn.Net:
    labels = read(spark, sf_dir, "labels")
    return byte_cnn.train(docs, labels.where(crc_bucket(F.col("doc_id"), 5) != 0))


@query
def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scores = byte_cnn.scored(docs, ["doc_id"], quality_net(spark, sf_dir, docs))
    return scores.select(
        "doc.doc_id", F.coalesce(crc_bucket(F.col("doc.doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


SQL["op1_voronoi_knn"] = """
WITH ints AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.uid, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = licences.known_digests(spark.createDataFrame(licences.known_texts(), "licence string, text string"))
    found = licences.scanned(read(spark, sf_dir, "documents"), ["doc_id"], known)
    return found.select("doc.doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    kept = f"regexp_replace(coalesce({text}, ''), '{licences.COPYRIGHT_LINE}', ' ', 'g')"
    plain = rf"' ' || regexp_replace(lower({kept}), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    for was, now in licences.SPELLINGS:
        plain = f"replace({plain}, ' {was} ', ' {now} ')"
    return f"trim(regexp_replace({plain}, ' +', ' ', 'g'))"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NOTICE_ROWS = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licences.known_texts())
SQL["op6_licence_digests"] = f"""
WITH known AS (
  SELECT sha256({_sql_canonical("text")}) AS digest, min(licence) AS licence FROM (VALUES {_NOTICE_ROWS}) v(licence, text) GROUP BY 1
), forms AS (
  SELECT doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
  UNION
  SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), {_quoted(licences.BLANK_LINES)})) FROM documents
), hits AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT doc_id, sha256({_sql_canonical("line")}) AS digest FROM lines) l JOIN known USING (digest) GROUP BY 1
)
SELECT f.doc_id, f.digest, k.licence, coalesce(h.notices, '') AS notices
FROM forms f LEFT JOIN known k ON f.digest = k.digest LEFT JOIN hits h ON f.doc_id = h.doc_id
"""


@query
def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))
    return records.select("page_id", "type", "record_id", "refers_to", "uri", "date", "content_type", "block", "block_digest", "source_digest", "source_payload_digest", "content_length")


@query
def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the pages as they stand in a file: responses and their derivatives."""
    sources = warc.responses(read(spark, sf_dir, "pages"))
    return warc.serialized(sources).unionByName(warc.serialized(warc.derivatives(sources)))


def _sql_resolved(text: str) -> str:
    for name, char in warc.REFERENCES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(char)})"
    code = "CASE WHEN len(d) <= 7 THEN TRY_CAST((CASE WHEN n[1] IN ('x', 'X') THEN '0x' ELSE '' END) || d AS INTEGER) END"
    coded = f"list_transform(list_transform(regexp_extract_all({text}, '{warc.NUMERIC}', 1), lambda n: {{'n': n, 'd': regexp_replace(n, '^[xX]?0*', '')}}), lambda s: {code.replace('n[1]', 's.n[1]').replace('(d)', '(s.d)').replace('|| d', '|| s.d')})"
    chars = f"list_transform({coded}, lambda c: CASE WHEN c = 38 THEN '&amp;' WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111 THEN chr(c) ELSE chr(65533) END)"
    parts = f"string_split_regex({text}, '{warc.NUMERIC.replace('(', '(?:')}')"
    joined = f"array_to_string(list_transform(list_zip({parts}, {chars}), lambda z: z[1] || coalesce(z[2], '')), '')"
    return f"replace(CASE WHEN contains({text}, '&#') THEN {joined} ELSE {text} END, '&amp;', '&')"


def _sql_text(html: str) -> str:
    text = f"coalesce({html}, '')"
    for pattern in warc.DROPPED:
        text = f"regexp_replace({text}, {_quoted(pattern)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {_quoted(warc.LINE_TAGS)}, chr(10), 'g'), {_quoted(warc.OTHER_TAGS)}, '', 'g')"
    text = _sql_resolved(text)
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g')"
    return rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"


def _sql_uuid(key: str) -> str:
    parts = " || '-' || ".join(f"substr({key}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {parts} || '>'"


SQL["op9_warc_derivatives"] = rf"""
WITH source AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html,
         sha256(concat_ws(chr(10), 'response', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), coalesce(html, ''))) AS key
  FROM pages
), named AS (
  SELECT *, {_sql_uuid("key")} AS refers_to, 'sha256:' || sha256(html) AS source_digest FROM source
), blocks AS (
  SELECT *, 'metadata' AS type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace({_sql_resolved("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)").replace("<title[", r"<title\b[")}, '\s+', ' ', 'g')) || chr(13) || chr(10)
    || 'language: ' || regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1) || chr(13) || chr(10)
    || 'charset: ' || lower(regexp_extract(html, {_quoted(warc.CHARSET)}, 1)) || chr(13) || chr(10)
    || 'outlinks: ' || len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) || chr(13) || chr(10)
    || 'source-digest: ' || source_digest || chr(13) || chr(10) || 'source-payload-digest: ' || source_digest || chr(13) || chr(10) AS block FROM named
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {_sql_text("html")} FROM named
), keyed AS (
  SELECT *, sha256(concat_ws(chr(10), type, refers_to)) AS own_key FROM blocks
)
SELECT page_id, type, {_sql_uuid("own_key")} AS record_id, refers_to, uri, '{warc.DATE}' AS date, content_type, block,
       'sha256:' || sha256(block) AS block_digest, source_digest, source_digest AS source_payload_digest, CAST(strlen(block) AS BIGINT) AS content_length
FROM keyed
"""
_HEAD = """
SELECT page_id, type, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || type, 'WARC-Record-ID: ' || record_id, 'WARC-Date: ' || date, {refers}
  'WARC-Target-URI: ' || uri, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type, 'Content-Length: ' || strlen(block), '', block, '', '') AS record
FROM ({of})"""
SQL["warc_records"] = _HEAD.format(refers="'WARC-Refers-To: ' || refers_to,", of=SQL["op9_warc_derivatives"]) + "\nUNION ALL" + _HEAD.format(refers="", of=f"""
  SELECT *, {_sql_uuid("key")} AS record_id FROM (
    SELECT page_id, 'response' AS type, '{warc.DATE}' AS date, 'text/html' AS content_type, coalesce(url, '') AS uri, coalesce(html, '') AS block,
      'sha256:' || sha256(coalesce(html, '')) AS block_digest,
      sha256(concat_ws(chr(10), 'response', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), coalesce(html, ''))) AS key FROM pages)""")


@query
def op13_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = token_stream.encoded(read(spark, sf_dir, "documents"), ["doc_id"], tokenizer=word_tokenizer())
    coded = coded.select("doc.doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    texts = token_stream.decoded(coded, ["doc_id", "n_tokens", "ids_sha256"], tokenizer=word_tokenizer())
    return texts.select("doc.doc_id", "doc.n_tokens", "doc.ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.coded(read(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    codes = codes.select("doc.vec_id", "doc.label", "code", "error")
    total = codes.groupBy(F.col("label").alias("own_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = F.lit(None if books is None else vector_codes.digest_of(books)).cast("string")
    joined = codes.join(total, F.col("label").eqNullSafe(F.col("own_label")))
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _sql_codes(entries: int = 256, parts: int = 4, rounds: int = 4) -> str:
    """Plain rounds of a full search."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), cut AS MATERIALIZED (
  SELECT r, p, list_slice(v, CAST(p * len(v) // {parts} + 1 AS BIGINT), CAST((p + 1) * len(v) // {parts} AS BIGINT)) AS x FROM kept, range({parts}) t(p)
), seeds AS (
  SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL ORDER BY e LIMIT {entries}
), book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN seeds USING (r))"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, d * 1000 + e) AS e, min(d) AS d
  FROM (SELECT r, cut.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d
        FROM cut JOIN book{k} b ON cut.p = b.p)
  GROUP BY r, p
)"""
        )
        if k < rounds:
            steps.append(
                f"""sums{k} AS (
  SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM near{k} JOIN cut USING (r, p), range(1, len(x) + 1) t(i) GROUP BY p, e, i
), book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM book{k} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e
)"""
            )
    steps.append(
        f"""coded AS (
  SELECT r, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)"""
    )
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 "
        "FROM kept JOIN coded USING (r), digest"
    )


SQL["op12_vector_codes"] = _sql_codes()


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


SQL["op11_hard_negatives"] = """
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS MATERIALIZED (
  SELECT a.uid, a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
         CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints a JOIN ints d ON a.vec_id % 100 = 0 AND d.uid <> a.uid
), positives AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.uid, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.uid = n.uid AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
