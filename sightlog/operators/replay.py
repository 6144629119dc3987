"""Ordered rules over session logs: gates, streaks, ledgers, memories, frame filters, traces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog.operators.segments import group_starts, in_order, ordered


def hysteresis(df: DataFrame, keys, order, value: Column, low, resume, name: str, reached: Column | None = None, segments=None):
    """Flag that is raised at or below ``low`` and lowered at or above ``resume`` (low < resume).

    The flag is the latest of these two events; rows that are not ``reached`` cause none.
    """
    event = F.when(value >= resume, False).when(value <= low, True)
    if reached is not None:
        event = F.when(reached, event)
    o = ordered(df, keys, order, segments).last_value(name, event)
    return o.result().withColumn(name, F.coalesce(name, F.lit(False)))


def streak(df: DataFrame, keys, order, hit: Column, reset: Column, name: str, segments=None) -> DataFrame:
    """Number of hits since the last reset; other rows leave it unchanged.

    It is the running number of hits minus that number at the latest reset, which is the largest
    one seen at any reset because the number never falls.
    """
    o = ordered(df.withColumns({"_hit": hit, "_reset": reset}), keys, order, segments)
    o = o.running_sum("_n", F.when(F.col("_hit"), 1).otherwise(0).cast("bigint"))
    o = o.running_max("_base", F.when(F.col("_reset"), F.col("_n")))
    out = o.result().withColumn(name, F.col("_n") - F.coalesce("_base", F.lit(0)))
    return out.drop("_hit", "_reset", "_n", "_base")


def run_length(df: DataFrame, keys, order, value: Column, name: str, segments=None) -> DataFrame:
    """Length so far of the run of equal values that a row belongs to."""
    o = ordered(df.withColumn("_v", value), keys, order, segments)
    o = o.row_number("_rn").previous("_p", F.struct("_v"))
    changed = F.col("_p").isNull() | ~F.col("_p")["_v"].eqNullSafe(F.col("_v"))
    o = o.running_max("_first", F.when(changed, F.col("_rn")))
    return o.result().withColumn(name, F.col("_rn") - F.col("_first") + 1).drop("_v", "_rn", "_p", "_first")


def changes(df: DataFrame, keys, order, value: Column, segments=None) -> DataFrame:
    """Rows whose value differs from the row before: the history without repeats, as rows."""
    o = ordered(df.withColumn("_v", value), keys, order, segments).previous("_p", F.struct("_v"))
    new = F.col("_p").isNull() | ~F.col("_p")["_v"].eqNullSafe(F.col("_v"))
    return o.result().filter(new).drop("_v", "_p")


def ledger(df: DataFrame, keys, order, delta: Column, name: str, segments=None) -> DataFrame:
    """Balance that is cut at 0 after each movement.

    The cut balance is the plain running sum plus the deepest debt it has ever had.
    """
    o = ordered(df, keys, order, segments).running_sum("_s", delta.cast("bigint"))
    o = o.running_max("_debt", -F.col("_s"))
    return o.result().withColumn(name, F.col("_s") + F.greatest(F.lit(0), F.col("_debt"))).drop("_s", "_debt")


def mean_abs_difference(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d) / F.size(a)


def keep_changed_frames(df: DataFrame, keys, order, vector: str, interval: int, threshold: float, cap: int, segments=None) -> DataFrame:
    """Every ``interval``-th frame that differs enough from the last kept one, at most ``cap`` per video: (keys, order, n_kept).

    Which frame is compared depends on every choice before, so a video's frames pass one task in order. It holds a batch and the last
    kept frame; distances of a stretch of frames to it are one array operation, and frames after the ``cap``-th are skipped.
    """
    numbered = ordered(df.select(*keys, *order, vector), keys, order, segments).row_number("_n").result()
    sampled = numbered.filter((F.col("_n") - 1) % interval == 0).select(*keys, *order, F.col(vector).cast("array<double>").alias("_v"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in sampled.schema.fields if f.name != "_v"]

    def run(batches):
        group, last, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, now = group_starts(batch, keys, group)
            group = now
            edges = [0, *(np.flatnonzero(starts[1:]) + 1), batch.num_rows]
            vectors = batch.column("_v")
            rows, counts = [], []
            for low, high in zip(edges, edges[1:]):
                if starts[low]:
                    last, n = None, 0
                frames = np.asarray(vectors.slice(low, high - low).flatten()).reshape(high - low, -1)
                at = 0
                while at < len(frames) and n < cap:
                    if last is not None:
                        at = _first_far(frames, at, last, threshold)
                        if at is None:
                            break
                    last, n = frames[at].copy(), n + 1
                    rows.append(low + at)
                    counts.append(n)
                    at += 1
            kept = batch.select([f.split(" ")[0] for f in fields]).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(counts, type=pa.int64())], names=[*kept.schema.names, "n_kept"])

    return in_order(sampled, keys, order, run, ", ".join([*fields, "n_kept long"]))


def _first_far(frames: np.ndarray, at: int, last: np.ndarray, threshold: float) -> int | None:
    """Place of the first frame from ``at`` on whose mean distance to ``last`` reaches the threshold."""
    size = 16
    while at < len(frames):
        # one addition after the other, as a plain sum over the values would have it
        apart = np.add.accumulate(np.abs(frames[at : at + size] - last), axis=1)[:, -1] / len(last)
        hit = np.flatnonzero(~(apart < threshold))
        if len(hit):
            return at + int(hit[0])
        at, size = at + size, size * 2
    return None


def until_terminal(df: DataFrame, keys, order: str, terminal: Column) -> DataFrame:
    """Rows of each group up to its first terminal row; groups without one stay whole."""
    stop = df.filter(terminal).groupBy(*keys).agg(F.min(order).alias("_stop"))
    j = df.join(stop, keys, "left")
    return j.filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")
