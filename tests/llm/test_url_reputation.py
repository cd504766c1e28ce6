import re

import duckdb

from conftest import SF01
from quotelens.llm import queries, url_reputation

RULES = queries.URL_RULES


def verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for v, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (v, rule)
    return host, path, best


def test_rules_and_parts(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q#f", "http://www.example.com/en/", "http://x.www.example.com/en/a", "//no",
            None, "", "ftp://h.net/es/", "http://h.net/fr/x", "http://net/es/", "http://com", "http://xcom/a", "http://É.com/a#b/c",
            "http://h.net?u=/es/", "a://b://c.com/d", "http://x\n.com/\ny"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "id long, bad int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, none, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = verdict(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (best and best[1])
        assert got[i]["verdict"] == (best[0] if best else "allow")
    assert url_reputation.judge(pages.limit(0), none, RULES).count() == 0


def test_bad_hosts_are_blocked_and_unknown_hosts_are_not(spark):
    rows = [(i, "http://bad.a.org/") for i in range(200)] + [(i, "http://good.b.org/") for i in range(200, 400)] + [
        (400, "http://new.c.org/"), (401, "http://sub.bad.a.org/"), (402, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame([(i, 1) for i in range(150)] + [(i, 0) for i in range(200, 400)] + [(402, None)], "id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_reputation.judge(pages, known, RULES).collect()}
    assert got[0] == got[199] == "block" and got[200] == "allow" and got[400] == "allow" and got[402] == "allow"


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF01}/{t}.parquet'")
    want = con.execute(queries.OP7_SQL).fetchall()
    cols = [c[0] for c in con.execute(queries.OP7_SQL).description]
    got = [tuple(r) for r in queries.QUERIES["op7_host_reputation"](spark, SF01).select(cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_domains():
    found = re.compile(url_reputation.DOMAIN).search
    assert found("a.b.co.uk")[1] == "b.co.uk" and found("a.b.com")[1] == "b.com" and found("host") is None
