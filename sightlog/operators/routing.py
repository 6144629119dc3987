"""Routing of frames between the local model and the teacher model, and its cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog.functions import geometry as g

NO_BUILDINGS = "本地模型未检出任何建筑"
NO_KEY = "未检出场景关键建筑"
MICRO = 1_000_000


def route_reasons(frames: DataFrame, boxes: DataFrame, key_class: Column, min_avg: float = 0.5) -> DataFrame:
    """Why a frame needs the teacher: nothing seen, low mean confidence, no key building.

    Confidences are summed as integers (millionths), so that the mean, and with it the route,
    does not depend on the order in which partial sums arrive.
    """
    micro = F.round(F.col("confidence") * MICRO).cast("bigint")
    per = boxes.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(micro).alias("s"), F.bool_or(key_class).alias("has_key")
    )
    mean = F.col("s") / (F.col("n") * MICRO)
    low = F.col("s") < F.col("n") * int(min_avg * MICRO)
    low_text = F.concat(
        F.lit("平均置信度 "), g.fixed_text(mean, 2), F.lit(f" < 阈值 {min_avg:.2f}")
    )
    reasons = F.when(F.col("n").isNull(), F.array(F.lit(NO_BUILDINGS))).otherwise(
        F.array_compact(F.array(F.when(low, low_text), F.when(~F.col("has_key"), F.lit(NO_KEY))))
    )
    return (
        frames.join(per, "frame_id", "left")
        .withColumn("reasons", reasons)
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("needs_teacher", F.size("reasons") > 0)
    )


def route_log(routed: DataFrame, forced: Column, no_teacher: Column) -> DataFrame:
    """Route per frame. A forced call has no reasons; a needed call without a teacher stays local."""
    route = (
        F.when(forced, "llm").when(F.col("needs_teacher") & no_teacher, "local_no_llm")
        .when(F.col("needs_teacher"), "llm").otherwise("local")
    )
    return routed.withColumn("forced", forced).withColumn("route", route).withColumn(
        "reasons", F.when(F.col("forced"), F.array().cast("array<string>")).otherwise(F.col("reasons"))
    )


def totals(log: DataFrame, *by) -> DataFrame:
    """Everything that is not the teacher route counts as local; only teacher rows cost tokens."""
    llm = F.col("route") == "llm"
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~llm).alias("local"),
        F.count_if(llm).alias("llm"),
        F.coalesce(F.sum(F.when(llm, F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(llm, F.col("completion_tokens"))), F.lit(0)).alias("completion_tokens"),
    ).withColumn("llm_ratio", F.round(F.col("llm") / F.col("total"), 4))


def reason_histogram(log: DataFrame) -> DataFrame:
    """Reasons of teacher rows, most frequent first; equal counts by name."""
    return (
        log.filter("route = 'llm'").select(F.explode("reasons").alias("reason")).groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")
    )
