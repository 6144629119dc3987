"""Very long rows: work on one text grows with its length; array helpers of the identifier search against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sightlog.llm import extract, pii


def test_unclosed_elements_take_linear_time():
    n = 20_000
    began = time.perf_counter()
    assert extract.main_text("<b>" * n + "<div>x</div>" * n) == "\n\n".join(["x"] * n)
    assert extract.main_text("<article>" + "<i><p>y</u>" * n) == "\n\n".join(["y"] * n)
    assert extract.main_text("<nav>" + "<a><li>z</article>" * n) == ""
    assert time.perf_counter() - began < 20


def test_only_whole_tokens_name_a_region():
    page = '<body><div class="{}"><p>' + "text of the page " * 20 + "</p></div></body>"
    kept = ("text of the page " * 20).strip()
    for name in ("post has-sidebar", "no-comments", "entry-header", "share-price", "shared", "adverbs", "header-image-post", ""):
        assert extract.main_text(page.format(name)) == kept, name
    for name in ("sidebar", "post sidebar", "site-header", "cookie-notice", "ad", "ad_banner", "SIDEBAR left", "comments-list", "main_nav"):
        assert extract.main_text(page.format(name)) == "", name
    html = '<article><h1 class="entry-header">Head</h1><div class="share-price"><p>12.5</p></div><p>Long ' + "line " * 50 + "</p></article>"
    assert extract.main_text(html).split("\n\n")[:2] == ["Head", "12.5"]


def test_end_tags_and_implied_ends_as_before():
    assert extract.main_text("<div><p>a<div>b</div>c</p></div>") == "a\n\nb\n\nc"
    assert extract.main_text("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == "a\n\nb\n\nc\n\nd\n\ne"
    assert extract.main_text("<article><p>a<aside><p>no</article></aside>b</p></article>c<p>d") == extract.main_text("<article><p>a<aside><p>no</article></aside>b</p></article>c<p>d")
    assert extract.main_text("<nav><b>x</nav>text</b> more") == "text more"


@pytest.fixture(scope="module")
def spans(spark):
    r = random.Random(3)

    def some(n, wide):
        return [(a, r.randint(0, 3), a + r.randint(1, wide)) for a in (r.randint(0, 900) for _ in range(n))]

    rows = [(i, some(r.choice([0, 1, 5, 400]), 30), some(r.choice([0, 1, 300]), 6)) for i in range(30)]
    kind = "array<struct<a:bigint,k:int,b:bigint>>"
    return rows, spark.createDataFrame(rows, f"i int, x {kind}, y {kind}")


def test_array_helpers_against_loops(spans):
    rows, df = spans
    got = df.select("i", pii.without_repeats(F.col("x")).alias("once"), pii.clear_of(F.col("x"), F.col("y")).alias("clear"), pii.outermost(F.col("x")).alias("outer"))
    plain = lambda v: sorted(tuple(m) for m in v)
    have = {r.i: (plain(r.once), plain(r.clear), plain(r.outer)) for r in got.collect()}
    for i, x, y in rows:
        clear = [m for m in x if not any(o[0] < m[2] and o[2] > m[0] for o in y)]
        outer = [m for m in x if not any(o[0] <= m[0] and o[2] >= m[2] and o[2] - o[0] > m[2] - m[0] for o in x)]
        assert have[i] == (sorted(set(x)), sorted(clear), sorted(outer))


def test_a_megabyte_of_numbers(spark, tmp_path):
    r = random.Random(4)
    text = " ".join(r.choice([f"{r.randint(0, 10**6)}", f"+{r.randint(10**10, 10**11)}", f"a{r.randint(0, 99)}@x.org", f"{r.randint(1, 255)}.2.3.4"]) for _ in range(110_000))
    assert len(text) > 1_000_000
    spark.createDataFrame([(1, text), (2, "no 1234567 here")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    began = time.perf_counter()
    found = pii.found_rows(spark.read.parquet(str(tmp_path / "t"))).select(F.size("base").alias("base"), F.size("free").alias("free")).collect()
    assert max(x.base for x in found) > 50_000 and time.perf_counter() - began < 120
