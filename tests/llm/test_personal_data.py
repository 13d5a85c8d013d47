import hashlib
import re

from packwise.llm import personal_data as pd_
from packwise.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def _plain(text):
    """The patterns as given."""
    text, out = text or "", {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    texts = [
        "", "a@b", "a@b.c.d@e.f", "x..y@@z.w", "@a.b", "a@b.c@d.e", "é1@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "01.002.0003.4", "0" * 4000 + "1.1.1.1", "1.1.1." + "9" * 3000, "4111 1111 1111 1111",
        "4111-1111-1111-1111-4111111111111111", "+1 (212) 555-0100 +1", "++123 456 789", "+12345678", "+1((((((", "a" * 3000 + "@" + "b" * 3000 + ".c", "1" * 3000 + ".1.1.1",
        "5500000000000004 5500000000000004", "a@b.c-@d.e", "a%b+c@d-.e-.f",
    ]
    for t in texts:
        assert pd_.base_spans(t) == _plain(t), t[:60]


def test_query_base_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op3_personal_data"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and sum(r.n_ip + r.n_email + r.n_card + r.n_phone for r in rows) > 5
    for r in rows:
        base = _plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pd_.KINDS)
        joined = ",".join(f"{k}:{a}:{b}" for k in pd_.KINDS for a, b in base[k])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert not joined or set(joined.split(",")) <= set(r.spans.split(","))


def test_the_field_finds_altered_forms_and_leaves_plain_text(spark):
    field = pd_.train(spark.read.parquet(f"{SMALL}/documents.parquet"), "text")
    for text, kind, value in (
        ("write to bob.lee at example dot com today", "email", "bob.lee at example dot com"),
        ("a card 4111.1111.1111.1111 here", "card", "4111.1111.1111.1111"),
        ("call 1 (212) 555-0100 now", "phone", "1 (212) 555-0100"),
    ):
        assert (kind, text.index(value), text.index(value) + len(value)) in field.added(text, pd_.base_spans(text)), text
    for text in ("on 12.03.2024 at 14:30 we met", "look at the dot", "rows 100 200 300", "sha 5e71cd2b7c08d8c9ac", "x " * 50):
        assert field.added(text, pd_.base_spans(text)) == []


def test_odd_rows_and_redaction(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "mail a.b@c.de, ip 1.2.3.4!", "x"), (3, "mail a.b@c.de, ip 1.2.3.4!", "x"), (4, "1" * 100_000 + " @" * 20_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    out = pd_.redacted(docs, docs.columns)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.base or "") for r in out.collect())[:4] == [
        (1, "", "a"), (2, "", ""), (3, "mail [EMAIL], ip [IP]!", "x"), (3, "mail [EMAIL], ip [IP]!", "x"),
    ]
    assert pd_.found(docs.limit(0), ["doc_id"]).count() == 0


def test_no_cut_in_long_runs_and_signs_in_any_case(spark):
    field = pd_.train(spark.read.parquet(f"{SMALL}/documents.parquet"), "text")
    value = "bob.lee at example dot com"
    for before in range(385, 403):  # the form moves over the places where runs were cut
        text = "x12 " * before + f"write to {value} today " + "x12 " * 30
        at = text.index(value)
        assert ("email", at, at + len(value)) in field.added(text, pd_.base_spans(text)), before
    for text in ("BOB AT EXAMPLE DOT COM", "bob [AT] example"):
        units = [u for u in pd_.clusters(text)]
        assert units and any(text[u[i][1] : u[j - 1][2]] == text for u in units for i, j in pd_.candidates(u, text)), text
