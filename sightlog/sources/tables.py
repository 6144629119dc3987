"""The given tables as perception logs.

Each function returns a DataFrame in the shape an operator expects: detections,
frames, ground truth, step logs, teacher output. Only projections are used, so
that filters and column pruning still reach the parquet scan and no shuffle is
spent before the operator itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightlog import vocab

CANVAS = (1280, 720)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as it is stored; its number of tasks follows from its files and row groups."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has, by ``keys``. For narrow rows that are about to grow inside their task: a few bytes a row move,
    and the long texts made from them are worked on by all cores, however few row groups the table has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per box. ``det_no`` orders the boxes of a frame and needs no window:
    it is the line number followed by part, supplier and quantity."""
    x1 = F.expr("CAST((l_suppkey * 131 + l_partkey * 17) % 1180 AS INT)")
    y1 = F.expr("CAST((l_partkey * 29 + l_suppkey * 7) % 640 AS INT)")
    side = F.expr("20 + 2 * CAST(l_quantity AS INT)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.expr(
            "CAST(l_linenumber AS BIGINT) * 1000000000000000000 + (l_partkey * 1000003 + l_suppkey) * 50 + CAST(l_quantity AS INT) - 1"
        ).alias("det_no"),
        F.expr("CAST(l_partkey % 17 AS INT)").alias("class_id"),
        F.expr(
            "CAST(100 - 9 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) / CAST(100 AS DOUBLE)"
        ).alias("confidence"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + side).alias("x2"),
        (y1 + side).alias("y2"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'ocr' WHEN 'N' THEN 'llm' ELSE 'local' END").alias(
            "source"
        ),
    )


def named_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).withColumn("type", vocab.class_name(F.col("class_id")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS frame_id",
        "o_custkey AS session_id",
        "o_orderdate AS ts",
        f"{CANVAS[0]} AS w",
        f"{CANVAS[1]} AS h",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split",
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected state (NULL = unlabelled) and expected signals per frame."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS frame_id",
        """CASE o_orderkey % 6 WHEN 0 THEN '村庄待机' WHEN 1 THEN '搜索中' WHEN 2 THEN '战斗中'
           WHEN 3 THEN '战斗结束' WHEN 4 THEN '捐兵-消息列表' END AS expected_state""",
        "o_orderkey % 6 = 0 AS exp_attack",
        "o_orderkey % 6 = 1 AS exp_search",
        "o_orderkey % 6 = 2 AS exp_end",
        "o_orderkey % 12 = 2 AS exp_next",
        "o_orderkey % 6 = 3 AS exp_return",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered signals per session; ``event_id`` is the order within a session."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS session_id",
        "event_id",
        "ts",
        "event_type",
        "value AS amount",
        "event_type = 'click' AS attack",
        "event_type = 'view' AND value < 60 AS search",
        "event_type = 'view' AND value >= 60 AS next_b",
        "event_type = 'signup' AS return_b",
        "event_type = 'error' AS end_b",
        "CASE WHEN event_type = 'purchase' THEN 1 + CAST(floor(value / 50) AS INT) ELSE 0 END AS n_targets",
    )


def local_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .filter("role = 'user'")
        .selectExpr(
            "conv_id AS session_id",
            "CAST(floor(turn / 2) AS BIGINT) AS step_no",
            "CAST(length(text) % 7 AS INT) AS state_id",
            "length(text) % 4 <> 0 AS executed",
        )
    )


def teacher_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .filter("role = 'assistant'")
        .selectExpr(
            "conv_id AS session_id",
            "CAST(floor(turn / 2) AS BIGINT) AS step_no",
            "length(text) % 3 <> 0 AS approved",
            "CASE WHEN length(text) % 5 = 0 THEN NULL ELSE CAST(length(text) % 6 AS INT) END AS corrected_id",
        )
    )


def _points(spark, sf_dir, where: str, *extra: str) -> DataFrame:
    return (
        detections(spark, sf_dir)
        .filter(where)
        .selectExpr("frame_id", *extra, "(x1 + x2) div 2 AS x", "(y1 + y2) div 2 AS y")
        .withColumn("x", F.col("x").cast("int"))
        .withColumn("y", F.col("y").cast("int"))
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "class_id < 6", "det_no", "class_id", "confidence").withColumn(
        "name", vocab.class_name(F.col("class_id"))
    )


def defences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "class_id IN (6, 7, 8, 9)")


def landable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "class_id >= 12")


def frame_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of targets, defences and landable places by role, from one scan."""
    role = "CASE WHEN class_id < 6 THEN 'target' WHEN class_id >= 12 THEN 'landable' WHEN class_id < 10 THEN 'defence' END AS role"
    return _points(spark, sf_dir, "class_id NOT IN (10, 11)", role)


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        detections(spark, sf_dir)
        .filter("class_id IN (10, 11)")
        .selectExpr("frame_id", "det_no AS wall_no", "x1", "y1", "x2", "y2")
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action log with missing coordinates, unlisted kinds and unlisted targets."""
    return detections(spark, sf_dir).selectExpr(
        "frame_id",
        "det_no",
        """CASE class_id % 5 WHEN 0 THEN 'tap' WHEN 1 THEN 'deploy' WHEN 2 THEN 'wait'
           WHEN 3 THEN 'stop' ELSE 'swipe' END AS kind""",
        "class_id AS target_id",
        "CASE WHEN det_no % 9 = 0 THEN NULL ELSE x2 END AS x",
        "CASE WHEN det_no % 9 = 0 THEN NULL ELSE y2 END AS y",
        "CASE WHEN det_no % 4 = 0 THEN x2 - 40 END AS troop_x",
        "CASE WHEN det_no % 4 = 0 THEN y2 + 30 END AS troop_y",
        "CASE WHEN det_no % 11 = 0 THEN NULL ELSE class_id END AS listed_id",
    )


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised text with its corner points (clockwise, as OCR engines give them)."""
    return detections(spark, sf_dir).selectExpr(
        "frame_id",
        "det_no",
        """CASE class_id WHEN 0 THEN concat('Gold: ', x1, ',', lpad(CAST(y1 AS STRING), 3, '0'))
             WHEN 1 THEN concat('金币 ', x1) WHEN 2 THEN concat('Elixir ', x1, ' ', y1)
             WHEN 3 THEN concat('圣水', y1) WHEN 4 THEN concat('dark ', x1) WHEN 5 THEN concat('黑油: ', y1)
             WHEN 6 THEN '点击进攻' WHEN 7 THEN 'Go back' WHEN 8 THEN '搜索对手' WHEN 9 THEN 'next >'
             WHEN 10 THEN '结束战斗' WHEN 11 THEN 'donate' WHEN 12 THEN '消息列表' WHEN 13 THEN concat('Lv ', x1 % 17)
             WHEN 14 THEN '关闭' WHEN 15 THEN '确认' ELSE 'x' END AS text""",
        "confidence",
        "array(struct(x1 AS x, y1 AS y), struct(x2 AS x, y1 AS y), struct(x2 AS x, y2 AS y), struct(x1 AS x, y2 AS y)) AS bbox",
    )
