"""Page corpus to catalogue records.

A page is one row, so everything inside it is done on that row: marker blocks by splitting
before each marker, fields by regular expression, children by exploding. Nothing is
shuffled until records of different pages meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import text as tx
from sightlog.sources.tables import spread

# where links and image names point; a crawl of another site passes its own
SITE = "https://pages.example"
IMAGES = "https://images.example"

BOM = "﻿"


def body(text: Column) -> Column:
    """Text without byte order marks at its start."""
    return F.regexp_replace(text, f"^{BOM}+", "")


def blocks(df: DataFrame, text: str, marker: str, pos: str, block: str) -> DataFrame:
    """One row per part of the text, cut before each ``marker``; part 0 lies before any marker
    unless the text starts with one."""
    parts = F.split(F.col(text), f"(?={marker})")
    return df.select("*", F.posexplode(parts).alias(pos, block))


def pairs(text: Column, pattern: str, first: str, second: str) -> Column:
    """All matches of a pattern with two groups, as an array of structs."""
    # the text is read once; groups are taken from the short matches
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias(first), F.regexp_extract(m, pattern, 2).alias(second)))


# --- fixed values: markup patterns of index pages ---------------------------------
TAB = r'(?i:<SwitchTabGroup)\s+(?i:id="cp-upgrade-)([a-zA-Z-]+)"'
LIST = r'(?i:<ListItems)\s+(?i:title)="([^"]*)"\s+(?i:imgFolder)="([^"]*)"'
ITEM = r'<[lL]istItem\s+name="([^"]*)"\s+imgSrc="([^"]*)"\s+link="([^"]*)"'
LIVE_TAB = r"id:`cp-upgrade-([a-z-]+)`,class:`cp-upgrade-item`"
LIVE_LIST = r"title:`([^`]+)`,imgFolder:`([^`]+)`"
LIVE_ITEM = r"name:`([^`]+)`,imgSrc:`([^`]+)`,link:`([^`]+)`"


def index_items(pages: DataFrame, text: str = "text", live: bool = False, site: str = SITE, images: str = IMAGES) -> DataFrame:
    """Index pages to one row per item with its tab and section and their positions."""
    tab, section, item = (LIVE_TAB, LIVE_LIST, LIVE_ITEM) if live else (TAB, LIST, ITEM)
    key = [c for c in pages.columns if c != text]
    clean = pages.withColumn(text, body(F.col(text)))
    tabs = blocks(clean, text, tab, "tab_no", "tab_text").withColumn("tab_id", F.regexp_extract("tab_text", tab, 1))
    tabs = tabs.filter("tab_id <> ''").drop(text)
    secs = blocks(tabs, "tab_text", section, "section_no", "sec_text").withColumns({
        "section": F.regexp_extract("sec_text", section, 1), "img_folder": F.regexp_extract("sec_text", section, 2),
    }).filter(F.col("sec_text").rlike(section)).drop("tab_text")
    three = [F.regexp_extract_all("sec_text", F.lit(item), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "img_src"), (3, "link"))]
    rows = secs.select(
        *key, "tab_no", "tab_id", "section_no", "section", "img_folder", F.posexplode(F.arrays_zip(*three)).alias("item_no", "i")
    )
    return rows.select(
        *key, "tab_no", F.coalesce(vocab.lookup(F.col("tab_id"), vocab.TAB_NAMES), F.col("tab_id")).alias("tab"),
        "section_no", "section", "item_no", tx.link_id(F.col("i.link")).alias("item_id"), F.col("i.name").alias("name"),
        F.col("i.link").alias("link"), F.concat(F.lit(f"{site}/upgrade/"), F.col("i.link")).alias("url"),
        F.concat(F.lit(f"{images}/"), "img_folder", F.lit("/"), F.col("i.img_src")).alias("thumb_url"),
    )


def locate(items: DataFrame, index: DataFrame, scope: list[str]) -> DataFrame:
    """(tab, section) of the first index entry with the item's link, else ('', '')."""
    first = index.groupBy(*scope, "link").agg(
        F.min_by(F.struct("tab", "section"), F.struct("tab_no", "section_no", "item_no")).alias("_at")
    )
    j = items.join(first, scope + ["link"], "left")
    return j.withColumn("tab", F.coalesce("_at.tab", F.lit(""))).withColumn("section", F.coalesce("_at.section", F.lit(""))).drop("_at")


# --- fixed values: markup patterns of detail pages --------------------------------
INFO = r'(?i:<UnitInfo)\b[^>]*(?i:imgSrc)="([^"]*)"'
GROUP = r"(?i:<UnitImgGroup)\b([^>]*)>"
IMAGE = r'(?i:<UnitImg)\b[^>]*(?i:imgTitle)="([^"]*)"\s+(?i:imgSrc)="([^"]*)"'
PROPERTY = r'(?i:<UnitProperty)\b[^>]*(?i:pKey)="([^"]*)"\s+(?i:pValue)="([^"]*)"'
NUMBER = r'(?i:<BuildingNumRow)\s+(?i:title)="([^"]*)"\s+(?i:num)="([^"]*)"'
TITLE = r"(?i:<SmallTitle>)\s*([^<\n]+?)\s*(?i:</SmallTitle>)"
TIME_ITEM = r'(?is)<TimelineItem\s+date="([^"]*)">(.*?)</TimelineItem>'
TIME_ROW = r"(?is)<TimelineRow>(.*?)</TimelineRow>"
EXTRA = r"tableExtraInfo\s*=\s*(\[[\s\S]*?\])"


def column_metadata(text: Column) -> Column:
    """The list of column descriptions that a page embeds, NULL without one."""
    return F.from_json(F.regexp_extract(text, EXTRA, 1), "ARRAY<MAP<STRING, STRING>>")


def detail_fields(pages: DataFrame, text: str = "text", images: str = IMAGES) -> DataFrame:
    """Scalar fields and flat children of a detail page."""
    t = F.col(text)
    fm = lambda k: F.coalesce(F.try_element_at("_fm", F.lit(k)), F.lit(""))
    info = F.regexp_extract(t, INFO, 1)
    rows = F.transform(
        pairs(t, TIME_ITEM, "date", "body"),
        lambda e: F.struct(
            F.trim(e["date"]).alias("date"),
            F.transform(
                F.filter(F.regexp_extract_all(e["body"], F.lit(TIME_ROW), F.lit(1)), lambda r: tx.strip(r) != ""), tx.clean_cell
            ).alias("rows"),
        ),
    )
    extra = column_metadata(t)
    return (
        pages.withColumn(text, body(t))
        .withColumn("_fm", tx.front_matter(t))
        .withColumns({
            "item_id": tx.link_id(F.col("link")),
            "name": tx.first_filled(fm("navTitle"), fm("shownTitle"), fm("title")),
            "title": fm("title"), "description": fm("description"), "module": fm("module"), "canonical": fm("canonical"), "wiki": fm("wiki"), "img_folder": fm("imgFolder"),
            "info_url": F.when(info != "", F.concat(F.lit(f"{images}/"), fm("imgFolder"), F.lit("/"), info)),
            "building_num": pairs(t, NUMBER, "title", "num"),
            "properties": pairs(t, PROPERTY, "key", "value"),
            "timeline": F.filter(rows, lambda e: e["date"] != ""),
            "extra_info": F.coalesce(extra, F.array()),
        })
        .drop("_fm")
    )


def image_groups(pages: DataFrame, key: list[str], text: str = "text", group=GROUP, image=IMAGE) -> DataFrame:
    """Images with the group they belong to: the nearest marker before them, else a nameless group
    that comes last."""
    b = blocks(pages.select(*key, text), text, group, "_pos", "_block")
    marked = F.col("_block").rlike(f"^{group}")
    title = F.regexp_extract(F.regexp_extract("_block", group, 1), r'title="([^"]*)"', 1)
    img = pairs(F.col("_block"), image, "level", "src")
    rows = b.select(
        *key, "_pos", F.when(marked, title).otherwise("").alias("group"), (~marked).cast("int").alias("fallback"),
        F.posexplode(img).alias("image_no", "i"),
    )
    return rows.select(*key, F.col("_pos").alias("group_no"), "fallback", "group", "image_no", F.col("i.level").alias("level"), F.col("i.src").alias("src"))


def notes(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """List lines between the notes heading and the next heading, cleaned."""
    b = blocks(pages.select(*key, text), text, TITLE, "_pos", "_block")
    b = b.filter(F.regexp_extract("_block", f"^{TITLE}", 1) == vocab.NOTES_HEADING)
    first = b.groupBy(*key).agg(F.min_by("_block", "_pos").alias("_block"))
    line = r"^(?:\d+\.|[-*])\s+(.*)$"
    lines = first.select(*key, F.posexplode(F.split("_block", r"\r?\n")).alias("line_no", "line"))
    return lines.withColumn("line", tx.strip(F.col("line"))).filter(F.col("line").rlike(line)).select(
        *key, "line_no", tx.clean_cell(F.regexp_extract("line", line, 1)).alias("note")
    )


# --- fixed values: the separator line of a pipe table, ends of a line ----------------
SEPARATOR = r"^\|[\s:\-|]+\|$"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def markdown_tables(text: Column) -> Column:
    """Pipe tables of a text as array<struct<headers, rows>>, in order.

    Lines that do not start with a bar are blanked, so islands of bar lines lie between empty lines. An island holds at most one table: its
    header is the line before the first separator (which is not the first line), its rows are all lines after that.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), tx.strip)
    barred = F.array_join(F.transform(lines, lambda x: F.when(x.startswith("|"), x).otherwise("")), "\n")
    islands = F.filter(F.split(F.regexp_replace(barred, r"^\n+|\n+$", ""), r"\n{2,}"), lambda x: x != "")
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), tx.strip)

    def table(island):
        rows = F.split(island, "\n")
        place = F.array_min(F.filter(F.transform(rows, lambda x, i: F.when((i > 0) & x.rlike(SEPARATOR), i)), lambda i: i.isNotNull()))
        # bound once: the rows and the place of the separator
        bound = F.transform(F.array(F.struct(rows.alias("rows"), place.alias("at"))), lambda v: F.when(v["at"].isNotNull(), F.struct(
            cells(F.get(v["rows"], v["at"] - 1)).alias("headers"),
            F.transform(F.filter(v["rows"], lambda _, i: i > v["at"]), cells).alias("rows"),
        )))
        return F.get(bound, F.lit(0))

    return F.filter(F.transform(islands, table), lambda t: t.isNotNull())


def tables(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Pipe tables with cleaned cells, the nearest title before them as label and the column metadata of their page as ``extra_info``."""
    extra = F.coalesce(column_metadata(F.col(text)), F.array().cast("array<map<string,string>>"))
    b = blocks(pages.select(*key, text, extra.alias("extra_info")), text, TITLE, "block_no", "_block")
    b = b.withColumn("label", F.regexp_extract("_block", f"^{TITLE}", 1))
    t = b.select(*key, "block_no", "label", "extra_info", F.posexplode(markdown_tables(F.col("_block"))).alias("table_no", "_t"))
    return t.select(
        *key, "block_no", "table_no", "label", F.transform("_t.headers", tx.clean_cell).alias("headers"),
        F.transform("_t.rows", lambda r: F.transform(r, tx.clean_cell)).alias("rows"), "extra_info",
    )


def detail_records(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Whole detail records: the fields of ``detail_fields`` and the nested image groups, tables and notes, in page order.

    ``key`` names a page; each list is gathered for its page alone.
    """

    def listed(rows: DataFrame, order: list[str], value: list[str], out: str) -> DataFrame:
        # by the order alone: values may hold maps, which have none
        at = lambda e: F.struct(*[e[o] for o in order])
        by_order = lambda a, b: F.when(at(a) < at(b), -1).when(at(a) > at(b), 1).otherwise(0)
        found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *value)), by_order).alias("_l"))
        one = (lambda e: e[value[0]]) if len(value) == 1 else (lambda e: F.struct(*[e[v].alias(v) for v in value]))
        return found.select(key, F.transform("_l", one).alias(out))

    images = image_groups(pages, [key], text).groupBy(key, "group_no", "fallback", "group").agg(
        F.array_sort(F.collect_list(F.struct("image_no", "level", "src"))).alias("_i")
    )
    images = images.withColumn("images", F.transform("_i", lambda i: F.struct(i["level"].alias("level"), i["src"].alias("src"))))
    parts = [
        listed(images, ["fallback", "group_no"], ["group", "images"], "image_groups"),
        listed(tables(pages, [key], text), ["block_no", "table_no"], ["label", "headers", "rows", "extra_info"], "tables"),
        listed(notes(pages, [key], text), ["line_no"], ["note"], "notes"),
    ]
    out = detail_fields(pages, text)
    for part in parts:
        name = part.columns[-1]
        empty = F.array().cast(part.schema[name].dataType)
        out = out.join(part, key, "left").withColumn(name, F.coalesce(F.col(name), empty))
    return out


# --- fixed values: calls of live page chunks. An element call with its tag and what its content starts with, a text call, a string, a bracket
CALL = r"a\(`\w+`(?:,(?:\s*null,)?\s*(?:`[^`]*`|\[)?)?"
CALL_PARTS = r"^a\(`(\w+)`(?:,(?:\s*null,)?\s*(?:`([^`]*)`|(\[))?)?"
TEXT_CALL = r"t\(`[^`]*`(?=[,)])"
CALL_TOKEN = rf"{CALL}|{TEXT_CALL}|`[^`]*+(?:`|$)|[()]"


def call_items(pages: DataFrame, row: str, text: str) -> DataFrame:
    """(row, items): element and text calls of each text in order, each with the number of items inside it, NULL if it is never closed, and
    the last text before it.

    Brackets are matched by windows: an opening and its closing bracket are neighbours among the brackets of one level, and the level
    is a running sum. Strings are tokens of their own, so brackets in them do not count.
    """
    c = F.col
    tokens = pages.select(row, F.posexplode(F.regexp_extract_all(c(text), F.lit(f"({CALL_TOKEN})"), F.lit(1))).alias("pos", "token"))
    parts = [F.regexp_extract("token", CALL_PARTS, i) for i in (1, 2, 3)]
    told = c("token").rlike("^t\\(`")
    tokens = tokens.withColumns({
        "tag": F.when(told, "t").when(c("token").startswith("a(`"), parts[0]),
        "text": F.when(told, F.regexp_extract("token", "`([^`]*)`", 1)).otherwise(parts[1]),
        "listed": parts[2] != "",
        "step": F.when(c("token") == ")", -1).when(c("token").startswith("`"), 0).otherwise(1),
    })
    so_far = Window.partitionBy(row).orderBy("pos")
    tokens = tokens.withColumns({
        "level": F.sum("step").over(so_far) + F.when(c("step") < 0, 1).otherwise(0),
        "seen": F.count("tag").over(so_far),
        "label": F.last(F.when(c("tag") == "t", c("text")), ignorenulls=True).over(so_far),
    })
    # a call is closed by the next bracket of its level
    peers = Window.partitionBy(row, "level", c("step") == 0).orderBy("pos")
    items = tokens.withColumn("inner", (F.lead("seen").over(peers) - c("seen")).cast("int")).filter("tag IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("pos", "tag", "text", "listed", "inner", "label")))
    return items.groupBy(row).agg(listed.alias("items"))


def calls_in(items: Column, tag: str) -> Column:
    """Closed calls of a tag among items, each with the items inside it."""
    found = F.transform(items, lambda e, i: F.when((e["tag"] == tag) & e["inner"].isNotNull(), F.struct(
        e["text"].alias("text"), e["listed"].alias("listed"), e["label"].alias("label"), F.slice(items, i + 2, e["inner"]).alias("inside")
    )))
    return F.filter(found, lambda e: e.isNotNull())


def call_tables(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Tables of live page chunks, written as nested calls, with the text call before them as label.

    Headers are the cells of the first closed head, rows those of the first closed body; rows without cells are left out. A cell is its
    string, or the joined text calls of its list. A table inside a cell is a table of its own too; what is never closed is none.
    """
    cell = lambda e: tx.clean_cell(
        F.when(e["listed"], F.array_join(F.transform(F.filter(e["inside"], lambda t: t["tag"] == "t"), lambda t: t["text"]), "")).otherwise(e["text"])
    )
    none = F.array().cast("array<string>")

    def cells(part, tag):
        return F.coalesce(F.transform(calls_in(part, tag), cell), none)

    within = lambda tag: F.get(calls_in(F.col("inside"), tag), F.lit(0))["inside"]
    # rows are dealt before their tokens are made: windows, lists and the join find them in place, and a task holds its share of the table
    numbered = spread(pages.select(key, text).withColumn("_row", F.monotonically_increasing_id()), "_row")
    found = call_items(numbered.select("_row", F.col(text)), "_row", text).select("_row", F.posexplode(calls_in(F.col("items"), "table")).alias("table_no", "_t"))
    parts = found.select("_row", "table_no", F.coalesce("_t.label", F.lit("")).alias("label"), F.col("_t.inside").alias("inside"))
    parts = parts.withColumns({"_head": within("thead"), "_body": within("tbody")})
    rows = F.filter(F.transform(calls_in(F.col("_body"), "tr"), lambda r: cells(r["inside"], "td")), lambda r: F.size(r) > 0)
    read = parts.select(
        "_row", "table_no", "label", F.coalesce(cells(F.col("_head"), "th"), none).alias("headers"),
        F.coalesce(rows, F.array().cast("array<array<string>>")).alias("rows"),
    )
    return numbered.select("_row", key).join(read, "_row").drop("_row")


def trim_category(details: DataFrame, tab: str = "英雄", arrays=("image_groups", "tables", "timeline", "building_num", "notes")) -> DataFrame:
    """Child arrays of one category are emptied."""
    def emptied(c):
        return F.when(F.col("tab") == tab, F.slice(F.col(c), 1, 0)).otherwise(F.col(c))

    return details.withColumns({c: emptied(c) for c in arrays if c in details.columns})


def chunk_link(html: Column, link: Column) -> Column:
    """First content chunk whose path contains the link, else the last one, else NULL."""
    found = F.regexp_extract_all(html, F.lit(r"(/assets/upgrade_[^\s\"']+\.lean\.js)"), F.lit(1))
    hit = F.filter(found, lambda c: c.contains(link))
    return F.coalesce(F.get(hit, F.lit(0)), F.try_element_at(found, F.lit(-1)))


# --- catalogue items ----------------------------------------------------------------

ITEM_SCHEMA = """id STRING, name STRING, section STRING, img_folder STRING,
 image_groups ARRAY<STRUCT<group: STRING, images ARRAY<STRUCT<level: STRING, src: STRING>>>>"""


def catalogue_images(items: DataFrame, sections: list[str] | None, files: DataFrame | None) -> DataFrame:
    """Item records to one row per image with a level. Sections are filtered before anything is
    exploded; without a level, or without its file in ``files`` (path), an image is dropped."""
    if sections is not None:
        items = items.filter(F.col("section").isin(sections))
    img = items.select("id", "name", "section", "img_folder", F.explode("image_groups").alias("g")).select(
        "id", "name", "section", "img_folder", F.explode("g.images").alias("i")
    )
    img = img.select(
        "id", "name", "section", tx.first_int(F.col("i.level")).alias("level"),
        F.concat_ws("/", "img_folder", F.col("i.src")).alias("path"),
    ).filter("level IS NOT NULL")
    return img if files is None else img.join(files, "path", "left_semi")


def catalogue_stats(images: DataFrame) -> DataFrame:
    """Independent counts by section, type and level and the total, in one pass."""
    return images.groupingSets(
        [["section"], ["name"], ["level"], []], "section", "name", "level"
    ).agg(F.count(F.lit(1)).alias("n_images"), F.count_distinct("id").alias("n_items"))
