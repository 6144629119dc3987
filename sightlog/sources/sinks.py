"""Writers. Data sets are tables partitioned by split, with a class table beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlog import vocab


def write_label_map(spark: SparkSession, out: str, names: list[str] = vocab.CLASSES) -> None:
    """Class table and the manifest of splits."""
    vocab.class_dim(spark, names).coalesce(1).write.mode("overwrite").json(f"{out}/classes")
    manifest = [("train", f"{out}/labels/split=train"), ("val", f"{out}/labels/split=val")]
    spark.createDataFrame(manifest, "split STRING, path STRING").coalesce(1).write.mode("overwrite").json(f"{out}/manifest")


def write_dataset(labels: DataFrame, states: DataFrame, out: str, names: list[str] = vocab.CLASSES) -> None:
    """``labels`` (split, frame_id, det_no, line) and ``states`` (split, frame_id, state)."""
    labels.write.mode("overwrite").partitionBy("split").parquet(f"{out}/labels")
    states.write.mode("overwrite").partitionBy("split").parquet(f"{out}/states")
    write_label_map(labels.sparkSession, out, names)


def write_label_text(labels: DataFrame, out: str) -> None:
    """Label lines as text, one folder per split."""
    labels.select("split", F.concat_ws(" ", "frame_id", "line").alias("value")).write.mode("overwrite").partitionBy("split").text(out)


def write_summaries(summary: DataFrame, steps: DataFrame, module: str, max_steps: int, out: str) -> None:
    """One summary per session with its module and step limit, and the step records beside it, keyed by session: a long
    session is many rows and never one record."""
    head = summary.withColumns({"module": F.lit(module), "max_steps": F.lit(max_steps)})
    head.write.mode("overwrite").json(f"{out}/summary")
    steps.write.mode("overwrite").json(f"{out}/steps")


def write_catalogue(index: DataFrame, details: DataFrame, out: str) -> None:
    """Item index and nested detail records, both keyed by link."""
    index.write.mode("overwrite").parquet(f"{out}/index")
    details.write.mode("overwrite").json(f"{out}/items")


def write_report(lines: DataFrame, out: str) -> None:
    """Report lines in reading order; the order is made by a range partitioned sort."""
    lines.orderBy("part", "pos", "path", "line", "col", "rule_id").select("text").write.mode("overwrite").text(out)
