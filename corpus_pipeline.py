"""From raw documents to packed sequences: each stage applies one operator to all that its predecessor kept.

Stages keep the columns of ``documents`` (``n_chars`` follows a changed text); the last returns pieces of sequences. Between stages
``run`` writes a table into the shared folder of ``spark.checkpoint.dir`` and reads it again, so a lost executor never
repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlog.llm import packing, pii, quality, repeats, similar
from sightlog.llm.common import table
from sightlog.session import materialise, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score reaches the cut. Scores are joined by row, so equal ids stay apart."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    as_ids = rows.select(F.col("row").alias("doc_id"), "text")
    marked = quality.document_statistics(as_ids).withColumnRenamed("doc_id", "row").join(rows.select("row", F.col("doc_id").cast("long").alias("doc_id")), "row")
    stats = materialise(marked)
    model = quality.train(stats.select("doc_id", "stats"), table(spark, sf_dir, "labels"))
    scored = quality.score(stats.select(F.col("row").alias("doc_id"), "stats"), model)
    good = scored.where("predicted = 1").select(F.col("doc_id").alias("row"))
    return rows.join(good, "row", "left_semi").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of like texts (five-word shingles, similarity 0.8 or more): the one with the smallest id, rows of
    one id by their place. Null ids come last."""
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    # places stand for ids: a kept row is the smallest id of its group, whatever the order of rows
    last = (1 << 63) - 1
    placed = rows.select("row", F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("place"), "text")
    return rows.join(similar.duplicates(placed).select("row"), "row", "left_anti").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages removed from the texts; a character of which only a part is left goes too. All documents stay."""
    cut = repeats.deduplicate(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    rows = docs.withColumn("uid", F.monotonically_increasing_id())
    found = pii.find(rows.select(F.col("uid").alias("doc_id"), "text")).where(F.size("spans") > 0)
    spans = found.select(F.col("doc_id").alias("uid"), "spans")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.redact(F.col("text"), F.col("spans")))
    joined = rows.join(spans, "uid", "left").withColumn("clean", text).drop("text").withColumnRenamed("clean", "text")
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("pii", pii_redaction),
    ("best-fit packing", best_fit_packing),
]

#: No stage but the packing is expressible in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
