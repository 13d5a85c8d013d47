import hashlib
import html as python_html

from pyspark.sql import functions as F

from packwise.llm import warc


def test_records_link_to_their_source(spark):
    html = '<html lang="en"><head><title> A\n title</title><style>p{}</style></head><body><p>One &amp; two<script>x("</p>")</script></p><a href="/u">go</a><br/>end</body></html>'
    rows = [(1, "http://a.b/c", html), (2, None, None), (3, "u", ""), (4, "u", "<p>" * 50_000 + "deep"), (1, "http://a.b/c", html)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, type string")
    sources = warc.responses(pages)
    made = warc.derivatives(sources)
    by = {(r.page_id, r.type): r for r in made.collect()}
    assert made.count() == 10 and len(by) == 8
    source = {r.page_id: r for r in sources.collect()}
    for (page, _), r in by.items():
        assert r.refers_to == source[page].record_id and r.uri == source[page].uri and r.date == source[page].date
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert r.source_digest == source[page].block_digest
    assert by[1, "conversion"].block == "One & two\ngo\nend"
    assert by[1, "metadata"].block.startswith("title: A title\r\nlanguage: en\r\ncharset: \r\noutlinks: 1\r\n")
    assert by[2, "conversion"].block == "" and by[4, "conversion"].block == "deep"
    text = {r.page_id: r.record for r in warc.serialized(made).where("type = 'conversion'").collect()}[1]
    head, body = text.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and f"WARC-Refers-To: {source[1].record_id}" in head
    assert body == "One & two\ngo\nend\r\n\r\n" and "Content-Length: 16" in head
    assert warc.serialized(sources).count() == 5 and warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_headers_and_dates_of_the_source(spark):
    head = "HTTP/1.1 203 Fine\r\nDate: Tue, 02 Jan 2024 00:00:00 GMT\r\ncontent-type: text/html; charset=latin1\r\nLast-Modified: Mon, 01 Jan 2024 00:00:00 GMT"
    rows = [(1, "http://a.b", "<meta charset='UTF-8'>body", head, "2024-01-02T00:00:00Z", "x"), (2, "http://a.b", "body", None, None, "x"), (3, "u", None, "", "2024-01-02T00:00:00Z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, http string, taken string, block string")
    sources = warc.responses(pages, head="http", date="taken")
    source = {r.page_id: r for r in sources.collect()}
    assert source[1].block == head + "\r\n\r\n" + rows[0][2] and source[1].content_type == "application/http; msgtype=response"
    assert source[1].payload_digest == "sha256:" + hashlib.sha256(rows[0][2].encode()).hexdigest() != source[1].block_digest
    by = {(r.page_id, r.type): r for r in warc.derivatives(sources).collect()}
    lines = by[1, "metadata"].block.split("\r\n")
    assert "charset: utf-8" in lines and "source-status: 203" in lines and "source-content-type: text/html; charset=latin1" in lines
    assert "source-last-modified: Mon, 01 Jan 2024 00:00:00 GMT" in lines and "source-http-date: Tue, 02 Jan 2024 00:00:00 GMT" in lines
    assert by[1, "conversion"].date == "2024-01-02T00:00:00Z" and by[1, "conversion"].block == "body" and by[1, "conversion"].source_payload_digest == source[1].payload_digest
    assert by[2, "metadata"].date == warc.DATE and "source-status" not in by[2, "metadata"].block and source[2].content_type == "text/html"
    assert by[3, "conversion"].block == "" and "source-status" not in by[3, "metadata"].block


def test_references_are_resolved_once(spark):
    cases = {
        "&#39;&#x41;&#X1f600;&#0228;": "'A\U0001f600ä", "&#0;&#xD800;&#1114112;&#99999999999;&#x110000;": "\ufffd" * 5, "&amp;#39;": "&#39;", "&#38;lt;": "&lt;", "&#38;amp;": "&amp;",
        "&amp;lt;": "&lt;", "&copy;&middot;&unknown;&#;&#x;&#12": "©·&unknown;&#;&#x;&#12", "": "", "&#0000000000000000065;": "A", "a&#66;" * 20_000: "aB" * 20_000,
    }
    rows = spark.createDataFrame(list(cases.items()), "text string, want string").select("want", warc.numbered(warc.named(F.col("text"))).alias("got"))
    assert all(r.got == r.want for r in rows.collect())
    sound = "&lt;&#60;&#x3c;&copy;&middot;&quot;&amp;&#8364;&#x20AC;"
    assert spark.createDataFrame([(sound,)], "t string").select(warc.numbered(warc.named(F.col("t")))).first()[0] == python_html.unescape(sound)
