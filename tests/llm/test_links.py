"""Targets of links against the standard library, and the SQL of the url filter on pages that use them."""

import html
from urllib.parse import urljoin, urlsplit

import duckdb
from pyspark.sql import functions as F

from sightlog.llm import url_filter

PAGES = ["http://a.org/x/y/z.html?q=1#f", "http://a.org", "http://a.org/", "https://a.org/dir/", "http://a.org/x"]
TARGETS = ["b.html", "../b", "./b", "../../b", "../../../b", "..", ".", "c/../d/./e", "/r/../s", "?p=1", "#top", "//h.net/k", "http://o.com/i/../j", "x?u=http://q/", "a/b/", "c/..", "p:q/r", "mailto:me"]


def test_targets_are_resolved_like_the_standard_library(spark):
    rows = [(u, t) for u in PAGES for t in TARGETS]
    df = spark.createDataFrame(rows, "u string, t string")
    for r in df.withColumn("named", url_filter.address(url_filter.resolved(F.col("t"), F.col("u")))).collect():
        if r.t in ("p:q/r", "mailto:me"):
            assert r.named is None
            continue
        want = urlsplit(urljoin(r.u, r.t))
        path = urlsplit(urljoin("http://x/", want.path)).path
        assert r.named == want.netloc + (path or "/") + ("?" + want.query if want.query else ""), (r.u, r.t)


def test_references_are_decoded(spark):
    texts = ["a?b=1&amp;c=2", "&#47;x&#x2F;y&#X3A;", "&quot;&lt;&gt;&apos;", "&amp;amp;", "plain", "&#036;1", "%26amp;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d for r in df.select(url_filter.decoded(F.col("t")).alias("d")).collect()] == [html.unescape(t) for t in texts]


def test_aliases_by_relative_links_in_both_engines(spark, tmp_path):
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://x.net/es/a/1.html", canonical("../../home.html")), (2, "http://x.net/home.html", ""), (3, "http://o.org/d/p?x=1", canonical("?a=1&amp;b=2")), (4, "http://o.org/d/p?a=1&b=2", canonical("http://x.net/fr/./1")),
        (5, "http://k.org/q/r", canonical("s")), (6, "http://k.org/q/s", '<meta http-equiv=refresh content="1; url=../../../t/">'), (7, "http://k.org/t/", canonical("http://x.net/fr/../fr/2")), (8, "http://m.org/a", canonical("mailto:x@x.net")),
        (9, "http://m.org/b", canonical("#c")), (10, "http://m.org", canonical("e/..")), (11, "http://m.org/", ""), (12, "http://n.org/x/", canonical("&#46;./y")), (13, "http://n.org/y", canonical("//x.net/es/")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "block", 13: "block"}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {r[0]: r[4] for r in con.execute(url_filter.SQL).fetchall()} == got
