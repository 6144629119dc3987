"""URL rules with redirect equivalence, in DataFrame functions only.

Each url gets the longest rule that fits its host (or a parent domain) and path prefix. Urls that no rule fits may still
be aliases of others: pages name redirects (meta refresh) and canonical addresses (link element), and an address is the
same over http and https and with any fragment. Distributed connected components over these edges propagate
decisions to aliases: an explicit allow in a component wins over a block, a block over the default.

Defined cases: null urls and urls without ``://`` have empty host and path, are judged by no rule and are nobody's alias;
null html holds no links; repeated rows give one row each; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import components, query, table

#: (verdict, host, path prefix); fixed values.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; ASCII letters lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Rules are few and known, so they are an expression."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def address(url: Column) -> Column:
    """What names a document whatever the scheme and the fragment: host, path without dot segments, and query; null without ``://``."""
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    search = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when((path == "") & (search == ""), "/").otherwise(without_dots(path)), search))


#: Characters of an address whose references are decoded; the ampersand comes last, so nothing is decoded twice.
REFERENCES = {**{c: "" for c in "/:=?#%+.-_~,;@!$()*[]"}, '"': "quot", "'": "apos", "<": "lt", ">": "gt", "&": "amp"}


def decoded(text: Column) -> Column:
    """An attribute's value with its character references decoded, as far as an address may hold them."""
    for char, pattern in reference_patterns():
        text = F.regexp_replace(text, F.lit(pattern), F.lit("\\$" if char == "$" else char))
    return text


def reference_patterns() -> list[tuple[str, str]]:
    return [(c, f"(?i)&(?:#0*{ord(c)}|#x0*{ord(c):x}{'|' + name if name else ''});") for c, name in REFERENCES.items()]


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    joined = F.concat(F.array_join(kept, "/"), F.when(last | (F.size(kept) == 1), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), joined).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The URL that a target names on the page ``url``, dot segments and all; null for other schemes."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.concat(root, F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/"))
    page = F.concat(root, F.when(path == "", "/").otherwise(path))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(page, target))
        .when(target.startswith("#") | (target == ""), url)
        .otherwise(F.concat(folder, target))
    )


def linked_addresses(html: Column, url: Column) -> Column:
    """Addresses that a page names as its canonical address or redirects to; relative ones resolve against the page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"))
    found = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)(?:\bhref\s*=\s*[\"']?|\burl\s*=\s*[\"']?)([^\"'\s>]+)", 1))
    full = F.transform(F.filter(found, lambda t: t != ""), lambda t: address(resolved(decoded(t), url)))
    return F.filter(full, lambda t: t.isNotNull())


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_root per row of ``pages``; ``edges`` (from_url, to_url) adds known redirects.

    Components are sought over addresses with an edge only; ``alias_root`` is the smallest address of a page's component, null
    for pages alone.
    """
    url = F.col("url")
    seen = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
        address(url).alias("address"), "url", "html",
    ).withColumn("own", rule_column(F.col("host"), F.col("path"), rules))
    named = seen.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select(
        F.col("address").alias("a"), F.explode(linked_addresses(F.col("html"), url)).alias("b")
    )
    if edges is not None:
        named = named.union(edges.select(address(F.col("from_url")), address(F.col("to_url"))))
    links = components(named.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    out = seen.select("page_id", "host", "path", "own", "address").join(links.withColumnRenamed("id", "address"), "address", "left")
    out = out.withColumn("root", F.coalesce("root", "address"))
    # one decision per component: of the rules of all its addresses, pages or not
    ends = links.select("root", F.concat(F.lit("http://"), "id").alias("end"))
    by_end = ends.select("root", rule_column(host_of(F.col("end")), path_of(F.col("end")), rules)["verdict"].alias("v"))
    decided = by_end.where("v IS NOT NULL").groupBy("root").agg(
        F.when(F.max(F.col("v") == "allow"), "allow").otherwise("block").alias("spread")
    )
    return out.join(decided, "root", "left").select(
        "page_id", "host", "path", F.col("own")["rule"].alias("rule"),
        F.coalesce(F.col("own")["verdict"], "spread", F.lit("allow")).alias("verdict"),
        F.when(F.col("root") != F.col("address"), F.col("root")).alias("alias_root"),
    )


def _case(host: str, path: str, what: int) -> str:
    """The longest fitting rule (what: 0) or its verdict (1) as a SQL expression."""
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    whens = (f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{pre}') THEN '{(h + pre, v)[what]}'" for v, h, pre in longest)
    return f"CASE {' '.join(whens)} END"


def _address(url: str) -> str:
    path = rf"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    search = rf"regexp_extract({url}, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1)"
    host = rf"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    return f"CASE WHEN contains({url}, '://') THEN {host} || CASE WHEN {path} = '' AND {search} = '' THEN '/' ELSE {_without_dots(path)} END || {search} END"


def _decoded(text: str) -> str:
    quoted = lambda v: v.replace("'", "''")
    for char, pattern in reference_patterns():
        text = f"regexp_replace({text}, '{pattern}', '{quoted(char)}', 'g')"
    return text


def _without_dots(path: str) -> str:
    """Single dots first, then a segment with the ``..`` after it, from the left, as often as a path of the given pages may need; dots above the root are dropped."""
    out = f"regexp_replace(regexp_replace({path}, '/(\\./)+', '/', 'g'), '/\\.$', '/')"
    for _ in range(8):
        out = f"regexp_replace(regexp_replace({out}, '^(/\\.\\.)+(/|$)', '/'), '/[^/]+/\\.\\.(/|$)', '/')"
    return f"regexp_replace({out}, '^(/\\.\\.)+(/|$)', '/')"


SQL = rf"""
WITH RECURSIVE seen AS (
  SELECT page_id, url, html, {_address("url")} AS address,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), tags AS (
  SELECT address, url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM seen
), targets AS (
  SELECT address, url, regexp_extract(tag, '(?is)(?:\bhref\s*=\s*["'']?|\burl\s*=\s*["'']?)([^"''\s>]+)', 1) AS t FROM tags
  WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') OR regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh\b')
), named AS (
  SELECT address, url, {_decoded("t")} AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM targets WHERE t <> ''
), whole AS (
  SELECT address, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '/') THEN root || t WHEN starts_with(t, '?') THEN root || CASE WHEN path = '' THEN '/' ELSE path END || t WHEN starts_with(t, '#') OR t = '' THEN url
    ELSE root || CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || t END AS f FROM named
), absolute AS (
  SELECT address AS a, f AS u FROM whole
), links AS (
  SELECT a, {_address("u")} AS b FROM absolute WHERE a IS NOT NULL AND contains(u, '://')
), ways AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (
  SELECT a, b FROM ways UNION SELECT a, a FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), judged AS (
  SELECT reach.a AS address, {_case("regexp_extract(b, '^[^/?]*')", "regexp_extract(b, '^[^/?]*([^?]*)', 1)", 1)} AS v FROM reach
), decided AS (
  SELECT address, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS spread FROM judged WHERE v IS NOT NULL GROUP BY 1
)
SELECT page_id, host, path, {_case("host", "path", 0)} AS rule, coalesce({_case("host", "path", 1)}, spread, 'allow') AS verdict
FROM seen LEFT JOIN decided USING (address)
"""


@query("op2_url_filter", SQL)
def op2_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).drop("alias_root")
