from packwise.llm import licences


def test_forms_and_odd_rows(spark):
    known = licences.known_digests(spark.createDataFrame(licences.NOTICES, "licence string, text string"))
    rows = [
        (1, None), (2, ""), (3, "RELEASED under the\tMIT Licence!!!"), (4, "Copyright (c) 2020 A. B.\nReleased under the MIT license"),
        (5, "prose\nLicensed under CC BY-NC 4.0.\nmore\nAll rights reserved\nlicensed under cc by-nc 4.0"), (6, "Released under the MIT License. And more."),
        (6, "Released under the MIT License. And more."), (7, "x " * 100_000 + "\n" + "Licensed under the Apache License, v2.0"),
        (8, "This Source Code Form is subject to the terms of the Mozilla Public Licence, version 2.0"),
    ]
    docs = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, digest string")
    got = sorted((r.doc.doc_id, r.licence or "", ",".join(r.notices)) for r in licences.scanned(docs, ["doc_id", "digest"], known).collect())
    assert got == [
        (1, "", ""), (2, "", ""), (3, "MIT", "MIT"), (4, "MIT", "MIT"), (5, "", "CC-BY-NC-4.0,all rights reserved"), (6, "", ""), (6, "", ""), (7, "", ""),
        (8, "MPL-2.0", "MPL-2.0"),
    ]
    assert licences.scanned(docs.limit(0), ["doc_id"], known).count() == 0
    assert licences.scanned(docs, ["doc_id"], known.limit(0)).where("licence is not null or size(notices) > 0").count() == 0


def test_whole_licence_texts_in_altered_form(spark):
    known = licences.known_digests(spark.createDataFrame(licences.known_texts(), "licence string, text string"))
    rows = []
    for name, text in licences.TEXTS:
        titled = text.split("\n\n", 1)[1]
        forms = [
            text, text.upper().replace("2020", "1999-2024"), text.replace(",", " ").replace('"', "'").replace("\n\n", "\r\n\r\n"),
            text.replace("License", "Licence"), text.replace("HOLDER", "OWNER").replace("Copyright (c) 2020", "(c) 2011 Someone\nCopyright 2013"),
            *([] if name == "Apache-2.0" else [titled]),  # its first paragraph is no title but a copyright line
        ]
        rows += [(name, form, True) for form in forms]
        rows += [(name, "prose before\n\n" + text + "\n\nprose after", False), (name, text + " one word more", None)]
    docs = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "doc_id long, name string, text string, whole boolean")
    for r in licences.scanned(docs, ["name", "whole"], known).collect():
        if r.doc.whole:
            assert r.licence == r.doc.name
        else:
            assert r.licence is None
        if r.doc.whole is False and r.doc.name not in ("0BSD", "BSD-2-Clause"):  # all their paragraphs but one short one stand in others too
            assert r.doc.name in r.notices


def test_query_equals_sql(spark):
    from checks.compare import connect, rows_of
    from packwise.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.01"
    for name in ("op6_licence_digests", "op9_warc_derivatives"):
        df, cur = QUERIES[name](spark, folder), connect(folder).execute(SQL[name])
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
