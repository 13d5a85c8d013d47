import random
import re

from packwise.llm import url_rules
from packwise.llm.queries import QUERIES, SQL


def _expected(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[3], best[2] if best else default)


def test_query_equals_sql(spark):
    from checks.compare import connect, rows_of

    folder = "/root/testdata/sf0.01"
    df = QUERIES["op2_url_rules"](spark, folder)
    cur = connect(folder).execute(SQL["op2_url_rules"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_nested_rules_hot_hosts_and_odd_urls(spark):
    rng = random.Random(4)
    hosts = ["a.com", "b.a.com", "com", "x.org", "é.org", "", "a.com.", "WWW.A.com", ".a.com", "c.b.a.com"]
    paths = ["", "/", "/a", "/a/b", "/a/b/c", "/A", "/é", "/a//"]
    rules = [(h.lower(), p, rng.choice(["allow", "block"])) for h in hosts[:5] + ["c.b.a.com"] for p in paths if rng.random() < 0.6]
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#/a/b', 'z', '/b'])}" for _ in range(600)]
    urls += ["https://a.com/a/b"] * 500 + [None, "", "a.com/a", "://", "x://?a", "http://" + "a." * 3000 + "com/a", "http://a.com/" + "a/" * 20_000, "s://a.com/a\n/b"]
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "i long, url string, host string, rule string")
    by = spark.createDataFrame(rules, "host string, path string, verdict string")
    for blocks in (1, 7, 64):
        got = {r.doc.i: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(frame, "url", by, blocks=blocks).collect()}
        assert got == {i: _expected(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_rules.judged(frame, "url", by.limit(0), default="block").collect()} == {"block"}
    assert url_rules.judged(frame.limit(0), "url", by).count() == 0
