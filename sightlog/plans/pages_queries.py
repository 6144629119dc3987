"""Queries on the page corpus and the catalogue made from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import text as tx
from sightlog.operators import catalogue as ct
from sightlog.operators import labels as lb
from sightlog.operators.segments import global_rank
from sightlog.plans.registry import query
from sightlog.plans.views import case
from sightlog.session import materialise
from sightlog.sources import tables as src

# Source pages are written out from the part table, one page per part, so that the expected
# result is known from the same columns.
INDEX_TEXT = """concat(CASE WHEN p_partkey % 2 = 0 THEN '\ufeff' ELSE '' END, '# home\n<SwitchTabGroup id="cp-upgrade-heroes" x>\n<ListItems title="', p_type, '" imgFolder="f', p_size,
 '">\n<ListItem name="', p_name, '" imgSrc="', p_size, '.png" link="', p_partkey, '-', p_brand, '">\n<listItem name="second" imgSrc="s.png" link="', p_partkey + 1, '-B">\n</ListItems>\n<switchtabgroup id="cp-upgrade-odd">\n<ListItems title="walls" imgFolder="w">\n<ListItem name="wall" imgSrc="w.png" link="', p_partkey, '-', p_brand, '">\n<ListItems title="empty" imgFolder="e">\n')"""

PARTS = """SELECT p_partkey, '英雄' AS tab, p_type AS section, 0 AS item_no, p_partkey::VARCHAR AS item_id, p_name AS name, p_partkey || '-' || p_brand AS link, concat('https://images.example/f', p_size, '/', p_size, '.png') AS thumb_url FROM part
UNION ALL SELECT p_partkey, '英雄', p_type, 1, (p_partkey + 1)::VARCHAR, 'second', (p_partkey + 1) || '-B', concat('https://images.example/f', p_size, '/s.png') FROM part
UNION ALL SELECT p_partkey, 'odd', 'walls', 0, p_partkey::VARCHAR, 'wall', p_partkey || '-' || p_brand, 'https://images.example/w/w.png' FROM part"""


def index_pages(spark, sf):
    return src.table(spark, sf, "part").select("p_partkey", F.expr(INDEX_TEXT).alias("text"))


@query("pg1_index_extract", f"SELECT *, 'https://pages.example/upgrade/' || link AS url FROM ({PARTS})")
def index_extract(spark, sf):
    i = ct.index_items(index_pages(spark, sf))
    return i.select("p_partkey", "tab", "section", "item_no", "item_id", "name", "link", "thumb_url", "url")


LIVE_TEXT = """concat('x(id:`cp-upgrade-town-hall`,class:`cp-upgrade-item`,[title:`', p_type, '`,imgFolder:`g`,items:[{name:`', p_name, '`,imgSrc:`a.png`,link:`', p_partkey, '-L`}]])')"""


@query(
    "pg1_live_index_extract",
    "SELECT p_partkey, '大本' AS tab, p_type AS section, p_partkey::VARCHAR AS item_id, p_name AS name, p_partkey || '-L' AS link FROM part",
)
def live_index_extract(spark, sf):
    pages = src.table(spark, sf, "part").select("p_partkey", F.expr(LIVE_TEXT).alias("text"))
    return ct.index_items(pages, live=True).select("p_partkey", "tab", "section", "item_id", "name", "link")


DETAIL_TEXT = """concat('\ufeff---\ntitle: "T ', p_name, '"\nnavTitle: ', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, '\nimgFolder: h_', p_size % 4, '\nmodule: ', p_type, '\ncanonical: /u/', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('\nwiki: https://wiki.example/', p_size) ELSE '' END, '\nbad line\n---\n',
 '<UnitInfo a="1" imgSrc="info', p_size, '.png">\n', CASE WHEN p_partkey % 4 = 0 THEN '<UnitImg imgTitle="0 级" imgSrc="pre.png">\n' ELSE '' END,
 '<UnitImgGroup title="', p_type, '">\n<UnitImg imgTitle="', p_size, ' 级" imgSrc="a', p_size, '.png"><UnitImg imgTitle="建造中" imgSrc="b.png">\n<unitimggroup cols="2">\n<UnitImg imgTitle="1 - 2 级" imgSrc="c.png">\n',
 '<BuildingNumRow title="TH', p_size % 9, '" num="', p_size, '">\n<UnitProperty pKey="brand" pValue="', p_brand, '"><UnitProperty x pKey="size" pValue="', p_size, '">\n',
 '<SmallTitle> 升级 ', p_size % 3, ' </SmallTitle>\n| 等级 | <b>费用</b> |\n|---|:--|\n| 1 | ', p_size, ' |\n| 2 |  a   b |\n\n| not | a table |\n',
 '<TimelineItem date="2024/0', 1 + p_size % 9, '/02"><TimelineRow>a <i>', p_name, '</i></TimelineRow><TimelineRow> </TimelineRow></TimelineItem><TimelineItem date=""><TimelineRow>z</TimelineRow></TimelineItem>\n',
 '<SmallTitle>重要说明</SmallTitle>\n1. first ', p_partkey, '\n- <b>second</b>  note\nplain\n<SmallTitle>其他</SmallTitle>\n- not a note\n|h|\n|-|\n',
 CASE WHEN p_partkey % 5 = 0 THEN 'tableExtraInfo = [{bad' ELSE concat('tableExtraInfo = [{"col": ', p_size, ', "n": "', p_type, '"}]') END, '\n')"""


def detail_pages(spark, sf):
    parts = src.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return src.spread(parts, "p_partkey").select(
        "p_partkey", F.expr("concat(p_partkey, '-', p_brand)").alias("link"), F.expr(DETAIL_TEXT).alias("text")
    )


@query(
    "pg2_detail_extract",
    """SELECT p_partkey, p_partkey::VARCHAR AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'T ' || p_name ELSE p_name END AS name, 'T ' || p_name AS title, p_type AS module,
  'h_' || p_size % 4 AS img_folder, '/u/' || p_partkey AS canonical, CASE WHEN p_partkey % 2 = 0 THEN 'https://wiki.example/' || p_size ELSE '' END AS wiki, concat('https://images.example/h_', p_size % 4, '/info', p_size, '.png') AS info_url FROM part""",
)
def detail_extract(spark, sf):
    return ct.detail_fields(detail_pages(spark, sf)).select("p_partkey", "item_id", "name", "title", "module", "img_folder", "canonical", "wiki", "info_url")


@query(
    "pg3_pairs_and_timeline",
    """SELECT p_partkey, 'TH' || p_size % 9 AS num_title, p_size::VARCHAR AS num, 2 AS n_properties, p_brand AS brand, 1 AS n_dates, concat('2024/0', 1 + p_size % 9, '/02') AS date, ['a ' || p_name] AS rows FROM part""",
)
def pairs_and_timeline(spark, sf):
    return ct.detail_fields(detail_pages(spark, sf)).selectExpr(
        "p_partkey", "building_num[0].title AS num_title", "building_num[0].num AS num", "size(properties) AS n_properties",
        "properties[0].value AS brand", "size(timeline) AS n_dates", "timeline[0].date AS date", "timeline[0].rows AS rows",
    )


@query(
    "pg4_pipe_tables",
    """SELECT t.*, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS n_columns, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS column_n FROM (
SELECT p_partkey, '升级 ' || p_size % 3 AS label, ['等级', '费用'] AS headers, [['1', p_size::VARCHAR], ['2', 'a b']] AS rows FROM part
UNION ALL SELECT p_partkey, '其他', ['h'], [] FROM part) t JOIN part USING (p_partkey)""",
)
def pipe_tables(spark, sf):
    return ct.tables(detail_pages(spark, sf), ["p_partkey"]).select(
        "p_partkey", "label", "headers", "rows", F.size("extra_info").alias("n_columns"), F.try_element_at(F.get("extra_info", F.lit(0)), F.lit("n")).alias("column_n"),
    )


@query("ud3_table_generator", "SELECT CAST(2 * count(*) AS BIGINT) AS n_tables, CAST(2 * count(*) AS BIGINT) AS n_rows FROM part")
def table_generator(spark, sf):
    """A row generator is an array of structs that is inlined."""
    t = detail_pages(spark, sf).select(F.inline(ct.markdown_tables(F.col("text"))))
    return t.agg(lb.count_rows("n_tables"), F.sum(F.size("rows")).cast("bigint").alias("n_rows"))


@query(
    "jo10_table_titles",
    """SELECT p_partkey, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_partkey, '升级 ' || p_size % 3 AS label FROM part UNION ALL SELECT p_partkey, '其他' FROM part) GROUP BY ALL""",
)
def table_titles(spark, sf):
    return ct.tables(detail_pages(spark, sf), ["p_partkey"]).groupBy("p_partkey", "label").agg(lb.count_rows("n"))


CALLS = """concat('t(`Upgrade ', p_size, '`,1),a(`table`,null,[a(`thead`,null,[a(`tr`,null,[a(`th`,null,`Level (x)`),a(`th`,null,[t(`Co`,1),t(`st`,1)])])]),a(`tbody`,null,[a(`tr`,null,[a(`td`,null,`1`),a(`td`,null,`', p_name, '`)]),a(`tr`,null,[])])]),t(`after`,1)')"""


@query(
    "pg5_nested_call_tables",
    "SELECT p_partkey, 'Upgrade ' || p_size AS label, ['Level (x)', 'Cost'] AS headers, [['1', p_name]] AS rows FROM part",
)
def nested_call_tables(spark, sf):
    pages = src.table(spark, sf, "part").select("p_partkey", F.expr(CALLS).alias("chunk"))
    return ct.call_tables(pages, "p_partkey", "chunk").drop("table_no")


@query("pg6_notes", "SELECT p_partkey, 'first ' || p_partkey AS note FROM part UNION ALL SELECT p_partkey, 'second note' FROM part")
def notes(spark, sf):
    return ct.notes(detail_pages(spark, sf), ["p_partkey"]).select("p_partkey", "note")


@query(
    "pg7_column_metadata",
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS n_columns, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS n FROM part",
)
def column_metadata(spark, sf):
    return ct.detail_fields(detail_pages(spark, sf)).select(
        "p_partkey", F.size("extra_info").alias("n_columns"), F.try_element_at(F.get("extra_info", F.lit(0)), F.lit("n")).alias("n")
    )


OWNED = """SELECT p_partkey, 0 AS fallback, p_type AS "group", p_size || ' 级' AS level, 'a' || p_size || '.png' AS src FROM part UNION ALL SELECT p_partkey, 0, p_type, '建造中', 'b.png' FROM part
UNION ALL SELECT p_partkey, 0, '', '1 - 2 级', 'c.png' FROM part UNION ALL SELECT p_partkey, 1, '', '0 级', 'pre.png' FROM part WHERE p_partkey % 4 = 0"""


@query("jo9_image_owner", OWNED)
def image_owner(spark, sf):
    return ct.image_groups(detail_pages(spark, sf), ["p_partkey"]).select("p_partkey", "fallback", "group", "level", "src")


@query(
    "jo9_paragraph_heading",
    """WITH b AS (SELECT page_id, unnest(string_split(regexp_replace(html, '(<h[1-6]>)', chr(1) || '\\1', 'g'), chr(1))) AS block,
  generate_subscripts(string_split(regexp_replace(html, '(<h[1-6]>)', chr(1) || '\\1', 'g'), chr(1)), 1) - 1 AS heading_no FROM pages),
h AS (SELECT page_id, heading_no, regexp_extract(block, '^<h[1-6]>([^<]*)', 1) AS heading, len(regexp_extract_all(block, '<p>')) AS n FROM b)
SELECT page_id, CAST(heading_no AS INT) AS heading_no, heading, CAST(n AS BIGINT) AS n_paragraphs FROM h WHERE n > 0""",
)
def paragraph_heading(spark, sf):
    b = ct.blocks(src.table(spark, sf, "pages").select("page_id", "html"), "html", "<h[1-6]>", "pos", "block")
    n = F.size(F.regexp_extract_all("block", F.lit("(<p>)"), F.lit(1)))
    heading = F.regexp_extract("block", "^<h[1-6]>([^<]*)", 1).alias("heading")
    return b.select("page_id", F.col("pos").cast("int").alias("heading_no"), heading, n.cast("bigint").alias("n_paragraphs")).filter("n_paragraphs > 0")


@query(
    "sc14_chunk_link",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 2 = 0 THEN concat('/assets/upgrade_', page_id, '-X.lean.js') ELSE '/assets/upgrade_last.lean.js' END AS chunk FROM pages""",
)
def chunk_link(spark, sf):
    tail = """CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('<script src="/assets/upgrade_none.lean.js"></script>', CASE WHEN page_id % 2 = 0 THEN concat('<link href="/assets/upgrade_', page_id, '-X.lean.js">') ELSE '' END, '<script src="/assets/upgrade_last.lean.js"></script>') END"""
    p = src.table(spark, sf, "pages").select("page_id", F.expr(f"concat(html, {tail})").alias("html"))
    return p.select("page_id", ct.chunk_link(F.col("html"), F.concat("page_id", F.lit("-X"))).alias("chunk"))


@query(
    "fn4_clean_cell",
    "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages",
)
def clean_cell(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", tx.clean_cell(F.col("html")).alias("plain"))


@query(
    "fn5_front_matter",
    "SELECT p_partkey, 'T ' || p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS nav, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5 END AS n_keys FROM part",
)
def front_matter(spark, sf):
    d = detail_pages(spark, sf).withColumn("fm", tx.front_matter(F.col("text")))
    return d.select(
        "p_partkey", F.try_element_at("fm", F.lit("title")).alias("title"), F.try_element_at("fm", F.lit("navTitle")).alias("nav"),
        F.size("fm").alias("n_keys"),
    )


@query("fn6_name_fallback", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'nav' ELSE '' END AS name FROM pages")
def name_fallback(spark, sf):
    p = src.table(spark, sf, "pages")
    m = F.col("page_id") % 3
    return p.select("page_id", tx.first_filled(F.when(m == 1, "nav").when(m == 0, ""), F.lit(None), F.when(m == 0, F.col("url"))).alias("name"))


@query("fn7_link_id", "SELECT l_partkey AS k, split_part(l_partkey || '-' || l_shipdate::DATE, '-', 1) AS id, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def link_id(spark, sf):
    li = src.table(spark, sf, "lineitem")
    link = F.concat_ws("-", F.col("l_partkey"), F.col("l_shipdate").cast("date"))
    return li.groupBy(F.col("l_partkey").alias("k"), tx.link_id(link).alias("id")).agg(lb.count_rows("n"))


@query("fn8_url_decode", "SELECT page_id, url FROM pages")
def url_decode(spark, sf):
    p = src.table(spark, sf, "pages").select("page_id", F.url_encode("url").alias("coded"))
    return p.select("page_id", F.url_decode("coded").alias("url"))


@query("fn10_safe_name", "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g') AS name FROM pages")
def safe_name(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query(
    "fn1_first_integer",
    "SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '[0-9]+', 0), '') AS BIGINT) AS first_number FROM documents",
)
def first_integer(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", tx.first_int(F.col("text")).alias("first_number"))


@query(
    "fn20_key_timestamps",
    """SELECT event_id, date_trunc('second', ts) AS started, CAST(ts AS DATE) AS day FROM events""",
)
def key_timestamps(spark, sf):
    e = src.table(spark, sf, "events").select(
        "event_id", F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_1f2e3d4c")).alias("sid"),
        F.date_format("ts", "yyyy/MM/dd").alias("day"),
    )
    return e.select(
        "event_id", F.to_timestamp(F.substring("sid", 1, 15), "yyyyMMdd_HHmmss").cast("timestamp_ntz").alias("started"),
        F.to_date("day", "yyyy/MM/dd").alias("day"),
    )


# --- index against details -------------------------------------------------------------------------


@query(
    "jo3_item_location",
    """WITH i AS (SELECT p_partkey AS page, 0 AS o, '英雄' AS tab, p_type AS section, p_partkey || '-' || p_brand AS link FROM part UNION ALL SELECT p_partkey, 1, '英雄', p_type, (p_partkey + 1) || '-B' FROM part
  UNION ALL SELECT p_partkey, 2, 'odd', 'walls', p_partkey || '-' || p_brand FROM part)
SELECT p.p_partkey, coalesce(arg_min(i.tab, i.o), '') AS tab, coalesce(arg_min(i.section, i.o), '') AS section FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE p_partkey || '-' || p_brand END AS link FROM part) p
LEFT JOIN i ON i.page = p.p_partkey AND i.link = p.link GROUP BY 1""",
)
def item_location(spark, sf):
    items = src.table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE concat(p_partkey, '-', p_brand) END AS link"
    )
    return ct.locate(items, ct.index_items(index_pages(spark, sf)), ["p_partkey"]).select("p_partkey", "tab", "section")


OUTCOME = """o AS (SELECT link, CASE WHEN link IN (SELECT p_partkey || '-' || p_brand FROM part WHERE p_partkey % 7 <> 0) THEN 'ok' ELSE 'failed' END AS status FROM (""" + PARTS + "))"


def outcomes(spark, sf):
    """Index entries against stored pages (some are missing); a miss is a row, not an abort."""
    pages = detail_pages(spark, sf).filter("p_partkey % 7 <> 0").select(F.col("link"), F.lit("ok").alias("status"))
    links = ct.index_items(index_pages(spark, sf)).select(F.url_encode("link").alias("link"))
    links = links.withColumn("link", F.url_decode("link"))
    return links.join(pages, "link", "left").withColumn("status", F.coalesce("status", F.lit("failed")))


@query("sc13_page_scan", f"WITH {OUTCOME} SELECT link, status, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ALL")
def page_scan(spark, sf):
    return outcomes(spark, sf).groupBy("link", "status").agg(lb.count_rows("n"))


@query("pg8_run_outcome", f"WITH {OUTCOME} SELECT status, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ROLLUP (status)")
def run_outcome(spark, sf):
    return outcomes(spark, sf).rollup("status").agg(lb.count_rows("n"))


@query("tk2_item_limit", f"SELECT p_partkey, item_no, tab FROM ({PARTS}) ORDER BY p_partkey, tab DESC, item_no LIMIT 100")
def item_limit(spark, sf):
    i = ct.index_items(index_pages(spark, sf)).select("p_partkey", "tab_no", "section_no", "item_no", "tab")
    return i.orderBy("p_partkey", "tab_no", "section_no", "item_no").limit(100).select("p_partkey", "item_no", "tab")


@query(
    "pr18_category_trim",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '英雄' ELSE '建筑' END AS tab, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS n_num, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS n_dates, 2 AS n_properties,
  CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END AS n_tables, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END AS n_notes, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE n END AS n_groups
  FROM part JOIN (SELECT p_partkey, CAST(count(DISTINCT (fallback, "group")) AS INT) AS n FROM (""" + OWNED + """) GROUP BY ALL) USING (p_partkey)""",
)
def category_trim(spark, sf):
    d = ct.detail_records(detail_pages(spark, sf), "p_partkey").withColumn("tab", F.expr("CASE WHEN p_partkey % 2 = 0 THEN '英雄' ELSE '建筑' END"))
    return ct.trim_category(d).select(
        "p_partkey", "tab", F.size("building_num").alias("n_num"), F.size("timeline").alias("n_dates"), F.size("properties").alias("n_properties"),
        F.size("tables").alias("n_tables"), F.size("notes").alias("n_notes"), F.size("image_groups").alias("n_groups"),
    )


# --- catalogue -----------------------------------------------------------------------------------------

IMAGES = f"""img AS (SELECT i.p_partkey::VARCHAR AS id, p.p_name AS name, p.p_type AS section, TRY_CAST(nullif(regexp_extract(level, '[0-9]+', 0), '') AS BIGINT) AS level, concat('h_', p_size % 4, '/', src) AS path
  FROM ({OWNED}) i JOIN part p USING (p_partkey)),
listing AS (SELECT DISTINCT path FROM img WHERE path NOT IN ('h_1/c.png', 'h_3/c.png')),
kept AS (SELECT * FROM img WHERE level IS NOT NULL AND path IN (SELECT path FROM listing))"""


def item_records(spark, sf):
    """Item JSON as the crawler stores it."""
    d = ct.detail_fields(detail_pages(spark, sf)).select("p_partkey", "item_id", "img_folder")
    part = src.table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    g = ct.image_groups(detail_pages(spark, sf), ["p_partkey"]).groupBy("p_partkey").agg(
        F.collect_list(F.struct("group", "level", "src")).alias("images")
    )
    groups = F.transform("images", lambda i: F.struct(i["group"].alias("group"), F.array(F.struct(i["level"].alias("level"), i["src"].alias("src"))).alias("images")))
    rec = F.struct(
        F.col("item_id").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("section"), "img_folder", groups.alias("image_groups")
    )
    return d.join(part, "p_partkey").join(g, "p_partkey").select(F.to_json(rec).alias("json"))


def catalogue(spark, sf, sections=None):
    items = item_records(spark, sf).select(F.from_json("json", ct.ITEM_SCHEMA).alias("r")).select("r.*")
    return ct.catalogue_images(items, sections, stored_images(spark, sf))


def stored_images(spark, sf):
    """The listing of image files: two folders lack their third image."""
    folder = F.concat(F.lit("h_"), F.col("p_size") % 4)
    folders = src.table(spark, sf, "part").select(folder.alias("folder")).distinct()
    owned = ct.image_groups(detail_pages(spark, sf), ["p_partkey"]).select("src").distinct()
    paths = folders.join(owned).select(F.concat_ws("/", "folder", "src").alias("path"))
    return paths.filter(~F.col("path").isin("h_1/c.png", "h_3/c.png"))


@query(
    "sc1_catalogue_scan",
    f"WITH {IMAGES} SELECT id, name, section, level, path FROM kept WHERE section IN ('ECONOMY', 'SMALL')",
)
def catalogue_scan(spark, sf):
    return catalogue(spark, sf, ["ECONOMY", "SMALL"])


@query("fi12_levels_only", f"WITH {IMAGES} SELECT level IS NOT NULL AS has_level, CAST(count(*) AS BIGINT) AS n FROM img GROUP BY 1")
def levels_only(spark, sf):
    i = ct.image_groups(detail_pages(spark, sf), ["p_partkey"])
    return i.groupBy(tx.first_int(F.col("level")).isNotNull().alias("has_level")).agg(lb.count_rows("n"))


@query(
    "ag2_catalogue_stats",
    f"WITH {IMAGES} SELECT section, name, level, CAST(count(*) AS BIGINT) AS n_images, CAST(count(DISTINCT id) AS BIGINT) AS n_items FROM kept GROUP BY GROUPING SETS ((section), (name), (level), ())",
)
def catalogue_stats(spark, sf):
    return ct.catalogue_stats(catalogue(spark, sf))


@query(
    "ag3_type_vocabulary",
    f"WITH {IMAGES} SELECT name, CAST(dense_rank() OVER (ORDER BY encode(name)) - 1 AS BIGINT) AS type_id, CAST((SELECT max(level) FROM kept) AS BIGINT) AS max_level FROM (SELECT DISTINCT name FROM kept)",
)
def type_vocabulary(spark, sf):
    # names with their largest level are stored, so that the images are read once
    levels = materialise(catalogue(spark, sf).groupBy("name").agg(F.max("level").alias("level")))
    names = global_rank(levels.select("name"), ["name"], "rank")
    top = levels.agg(F.max("level").alias("max_level"))
    return names.join(F.broadcast(top), how="cross").select("name", (F.col("rank") - 1).alias("type_id"), "max_level")


@query(
    "pr22_item_preview",
    f"WITH {IMAGES} SELECT id, any_value(name) AS name, CAST(count(*) AS BIGINT) AS n_images, list_sort(list(DISTINCT level)) AS levels FROM kept GROUP BY id",
)
def item_preview(spark, sf):
    return catalogue(spark, sf).groupBy("id").agg(
        F.first("name").alias("name"), lb.count_rows("n_images"), F.array_sort(F.collect_set("level")).alias("levels")
    )
