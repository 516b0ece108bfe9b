import collections

import duckdb
import pytest

from clinloom.llm import op3_url_filters as o
from clinloom.llm.catalog import ORACLES
from tests.llm.helpers import SF


def canonical(u):
    return f'<html><head><LINK  href="{u}" rel="canonical"></head>'


def refresh(u):
    return f"<meta http-equiv='refresh' content='0; url={u}'>"


PAGES = [(1, "http://a.net/x", canonical("https://b.example.org/es/1")), (2, "https://a.net/x#f", None),
         (3, "http://c.net/p?q=1", canonical("/x2")), (4, "http://c.net/x2", refresh("http://a.net/x")), (5, None, None),
         (6, "nourl", canonical("http://a.net/x")), (7, "http://D.NET", canonical("rel.html")),
         (8, "http://d.net/rel.html", refresh("http://z.com/fr/1")), (9, "http://d.net", None),
         (10, "http://e.net/de/", None), (11, "http://e.com/de/", None), (12, "HTTP://WWW.Example.ORG/en/12?x", ""),
         (13, "http://example.org", None), (14, "http://f.net/a/b", canonical("//g.net/h")),
         (15, "http://g.net/h", canonical("http://h.com/de/k")), (1, "http://a.net/x", canonical("https://b.example.org/es/1")),
         (16, "x://", None), (17, "http://notexample.org/es/1", None), (18, "http://m.net/q", canonical("http://a.net/x")),
         (None, "http://k.org/a", None), (19, "http://both.net/", canonical("http://b.example.org/es/1") + refresh("http://z.com/fr/9"))]


def both(spark, pages, path):
    got = collections.Counter(tuple(r) for r in o.filter_urls(pages).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}')")
    return got, collections.Counter(con.execute(ORACLES["op3_url_filters"]).fetchall())


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf):
    got, want = both(spark, spark.read.parquet(f"{sf}/pages.parquet"), f"{sf}/pages.parquet")
    assert got == want


def test_aliases_and_defined_cases(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS rule", "2 AS host", "3 AS node")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    got, want = both(spark, df, f"{tmp_path}/p/*.parquet")
    assert got == want
    verdict = {r.page_id: (r.rule, r.verdict) for r in o.filter_urls(df).collect()}
    assert verdict[1] == (None, "allow")               # its component holds an explicit allow (page 19's target)
    assert verdict[8] == (None, "allow") and verdict[15] == (None, "block") and verdict[14] == (None, "block")
    assert verdict[13] == (None, "allow") and verdict[17] == ("org/", "allow") and verdict[11] == ("com/de/", "block")
    assert o.filter_urls(df.limit(0)).count() == 0


def test_given_redirects_and_long_chains(spark):
    n = 60
    pages = spark.createDataFrame([(i, f"http://s{i}.net/", None) for i in range(n)], "page_id long, url string, html string")
    hops = spark.createDataFrame([(f"http://s{i}.net/", f"http://s{i + 1}.net/") for i in range(n - 1)]
                                 + [(f"http://s{n - 1}.net/", "http://bad.com/de/")], "source string, target string")
    out = o.filter_urls(pages, edges=hops).collect()
    assert {r.verdict for r in out} == {"block"} and len({r.alias_of for r in out}) == 1
    hub = spark.createDataFrame([(f"http://s{i}.net/", "http://x.com/fr/") for i in range(n)], "source string, target string")
    assert {r.verdict for r in o.filter_urls(pages, edges=hub.union(hops)).collect()} == {"allow"}
