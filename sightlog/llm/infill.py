"""Fill-in-middle transformation by counted quantifiers.

``regexp_count`` gives the number n of units (code points; a dot with ``(?s)`` is one) of a text. Two hashes of the id cut it at a <= b, and a pattern
of the row's own, ``\\A(.{a}+)(.{b-a}+)(.*+)\\z``, captures prefix, middle and suffix in one match: counted and possessive, so nothing is tried twice
and the work is linear in the text. The replacement names the groups in the order of the row's form. The way back matches the markers.

All of it are column functions in one scan without a shuffle; a text is changed inside its row, however long it is.

Defined cases: a null text is empty and an empty text is plain; a text that holds one of the markers is plain; a null id counts as
the empty string in the hash; repeated rows give one row each; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import query, table

#: One code point.
UNIT = "(?s)."
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
SEED, PLAIN_FROM, SUFFIX_FIRST_BELOW = 1, 90, 20


def hash_groups(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight hex digits of SHA-256 of ``seed:doc_id``, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(documents: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, suffix_first_below: int = SUFFIX_FIRST_BELOW, marks: dict[str, str] = MARKS) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output of every row."""
    h1, h2, h3, h4 = hash_groups(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = F.lit(False)
    for mark in marks.values():
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first_below, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    pattern = F.concat(F.lit(r"(?s)\A(.{"), F.col("a"), F.lit("}+)(.{"), F.col("b") - F.col("a"), F.lit(r"}+)(.*+)\z"))
    p, s, m = marks["prefix"], marks["suffix"], marks["middle"]
    order = F.when(F.col("form") == "psm", F.lit(f"{p}$1{s}$3{m}$2")).otherwise(F.lit(f"{s}$3{p}$1{m}$2"))
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", "text", "n", "form", F.when(moved, F.col("a")).alias("prefix_chars"), F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(moved, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"),
    )


def restore(output: Column, form: Column, marks: dict[str, str] = MARKS) -> Column:
    """The text before the transformation; it holds no marker, so the first of each is the one that was set."""
    p, s, m = marks["prefix"], marks["suffix"], marks["middle"]
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, left(text, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
sha256(text) AS restored_sha256 FROM p
"""


@query("op12_infill", OP12_SQL)
def op12_infill(spark, sf_dir):
    done = transform(table(spark, sf_dir, "documents"))
    back = restore(F.col("output"), F.col("form"))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"), _sha(back).alias("restored_sha256"))
