import os

import duckdb

from eventide.llm import queries, url_filter
from tests.llm.helpers import empty, labels

PAGES = "page_id long, url string, host string, bound string"
SF = os.environ.get("EVENTIDE_SF", "/root/testdata/sf0.001")


def judged(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], PAGES)
    seen = spark.createDataFrame(list(outcomes), "host string, good int")
    return {r.page_id: r for r in url_filter.url_verdicts(pages, seen).collect()}


def test_parts_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/x?q#f", "https://example.net", "x://b.example.com/de/1", "//no/scheme", None, "ftp://ÀB.org:80/fr/?x",
        "http://net/en/", "http://example.net/en/", "http://org/fr/1", "http://x?y://z/", "",
    ]
    got = judged(spark, urls)
    assert [(got[i].host, got[i].path) for i in range(len(urls))] == [
        ("a.example.net", "/en/x"), ("example.net", ""), ("b.example.com", "/de/1"), ("", ""), ("", ""), ("Àb.org:80", "/fr/"), ("net", "/en/"), ("example.net", "/en/"), ("org", "/fr/1"), ("x", ""), ("", ""),
    ]
    assert [got[i].rule for i in range(len(urls))] == ["example.net/en/", None, "example.com/de/", None, None, None, "net/", "example.net/en/", "org/fr/", None, None]
    assert [got[i].verdict for i in (0, 2, 4, 6, 8)] == ["allow", "block", "allow", "block", "allow"]


def test_hosts_shrink_towards_their_domain(spark):
    seen = [("bad.a.com", 0)] * 40 + [("new.a.com", 0)] * 2 + [("good.b.com", 1)] * 60 + [("new.b.com", 1)] * 30 + [("h.c.org", 1)] * 50 + [(None, 1), ("x", None)]
    got = judged(spark, ["http://bad.a.com/", "http://new.a.com/", "http://good.b.com/", "http://h.c.org/", "http://none.z/"], seen)
    assert [got[i].verdict for i in range(4)] == ["block", "block", "allow", "allow"]
    rows = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(seen, "host string, good int")).collect()}
    assert all(0 <= r.bound <= r.mean <= 1 for r in rows.values()) and rows["bad.a.com"].mean < rows["new.a.com"].mean < 0.6


def test_unseen_hosts_take_their_domain_then_suffix_then_all(spark):
    seen = [(f"h{i}.bad.com", 0) for i in range(30)] * 3 + [(f"h{i}.good.com", 1) for i in range(30)] * 3
    seen += [(f"h.d{i}.dirty", 0) for i in range(30)] * 3 + [(f"h.d{i}.clean", 1) for i in range(60)] * 3
    urls = ["http://new.bad.com/", "http://new.good.com/", "http://x.new.dirty/", "http://x.new.clean/", "http://x.y.unknown/", "no url", None]
    got = judged(spark, urls, seen)
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    assert len({got[i].verdict for i in (4, 5, 6)}) == 1 and got[5].host == got[6].host == ""
    few = judged(spark, ["http://a.b.c/"], [("h.x.y", 0)] * 50)
    assert few[0].verdict == "block" and judged(spark, ["http://a.b.c/"])[0].verdict == "allow"


def test_awkward_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.com/1", "x", "y"), (1, "http://a.com/1", "x", "y"), (1, "http://a.com/1", "x", "y"), (2, None, None, None)], PAGES)
    got = url_filter.url_verdicts(pages, url_filter.page_outcomes(pages, labels(spark))).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "None"] and {r.host for r in got} == {"a.com", ""}


def test_empty(spark):
    none = spark.createDataFrame([], "host string, good int")
    assert url_filter.url_verdicts(empty(spark, PAGES), none).count() == 0
    assert url_filter.page_outcomes(empty(spark, PAGES), labels(spark)).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted(con.execute(f"select page_id, host, path, rule, verdict from ({queries.OP7_SQL})").fetchall(), key=str)
    got = queries.op7_url_filter(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == want and want
