"""Readers for the files that perception tools leave behind. Schemas are fixed, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlog.operators.catalogue import ITEM_SCHEMA

BOX = "type STRING, bbox ARRAY<DOUBLE>, coords ARRAY<DOUBLE>, confidence DOUBLE"
LOCAL_STEP = f"step INT, state STRING, detections ARRAY<STRUCT<{BOX.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY').replace(' DOUBLE', ': DOUBLE')}>>"
TEACHER_STEP = LOCAL_STEP.replace("step INT, state STRING, detections", "approved BOOLEAN, corrected_state STRING, missed_objects")


def _stem(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, split, line) of label text files; the split is the folder a file lies in."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
    path = F.col("_metadata.file_path")
    return t.select(
        _stem(path).alias("stem"), F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("split"), F.col("value").alias("line")
    )


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, class_name) of a stored label map with text keys."""
    t = spark.read.text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("k", "class_name")
    return t.select(pairs).select(F.col("k").cast("int").alias("class_id"), "class_name")


def _step_key(df: DataFrame, kind: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.select(
        "*", F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1).alias("session"),
        F.regexp_extract(path, rf"(step_\d+)_{kind}\.json$", 1).alias("step_file"),
    )


def summarised_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions whose folder has a summary file."""
    t = spark.read.option("pathGlobFilter", "session_summary.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    return t.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("session")).distinct()


def step_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Local step files with the teacher's file of the same step, for sessions that have a summary."""
    read = lambda glob, schema: spark.read.schema(schema).option("multiLine", True).option(
        "recursiveFileLookup", True).option("pathGlobFilter", glob).json(folder)
    local = _step_key(read("step_*_local.json", LOCAL_STEP), "local")
    teacher = _step_key(read("step_*_coach.json", TEACHER_STEP), "coach")
    return local.join(teacher, ["session", "step_file"], "left").join(summarised_sessions(spark, folder), "session", "left_semi")


def teacher_samples(spark: SparkSession, folder: str) -> DataFrame:
    """(name, meta, content) of recorded samples: broken meta gives NULL, a missing image gives no content."""
    metas = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(
        _stem(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("raw")
    )
    image = F.from_json("raw", "image STRING")
    metas = metas.withColumn("meta", F.when(F.try_parse_json("raw").isNotNull(), image)).withColumn("image", F.col("meta.image"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("image"), "content")
    return metas.join(files, "image", "left").select("name", "raw", "meta", "content")


def catalogue_items(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ITEM_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a folder, relative to it; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    root = folder.rstrip("/")
    return files.select(F.substring_index("path", root + "/", -1).alias("path"))


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of text files below a folder; undecodable bytes become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/")
    return files.select(
        F.substring_index("path", root + "/", -1).alias("path"), F.try_make_valid_utf8(F.col("content").cast("string")).alias("content")
        if hasattr(F, "try_make_valid_utf8") else F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(link, text) of stored pages; byte order marks at the start are removed."""
    t = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return t.select(_stem(F.col("_metadata.file_path")).alias("link"), F.regexp_replace("value", "^﻿+", "").alias("text"))
