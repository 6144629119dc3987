"""Label tables: counts, states by class set, dataset unions, triage and quotas."""

from __future__ import annotations

from bisect import insort
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.operators.segments import SEG, group_starts, in_order, join_segments, ordered
from sightlog.session import materialise

N = len(vocab.CLASSES)


def count_rows(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def dataset_stats(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes per class and in total (class_id NULL); images without boxes count as images."""
    images = frames.agg(count_rows("n_images"))
    per_class = boxes.join(frames.select("frame_id"), "frame_id", "left_semi").rollup("class_id").agg(
        count_rows("n_boxes")
    )
    return images.join(F.broadcast(per_class), how="cross").select("class_id", "n_images", "n_boxes")


def frame_features(boxes: DataFrame) -> DataFrame:
    """[max confidence per class] + [count per class]; unknown classes are ignored."""
    known = boxes.filter(F.col("class_id").between(0, N - 1)).withColumn(
        "confidence", F.coalesce("confidence", F.lit(0.5))
    )
    aggs = []
    for i in range(N):
        hit = F.col("class_id") == i
        aggs.append(F.max(F.when(hit, F.col("confidence"))).alias(f"m{i}"))
        aggs.append(F.count_if(hit).alias(f"c{i}"))
    wide = known.groupBy("frame_id").agg(*aggs)
    return wide.select(
        "frame_id",
        F.array(
            *[F.greatest(F.coalesce(F.col(f"m{i}"), F.lit(0.0)), F.lit(0.0)) for i in range(N)],
            *[F.col(f"c{i}").cast("double") for i in range(N)],
        ).alias("features"),
    )


def state_of_classes(has) -> Column:
    """Frame state from the set of classes; ``has(name)`` tells whether a class is present."""
    any_of = lambda *names: reduce(lambda a, b: a | b, [has(n) for n in names])
    return (
        F.when(has("请求条目"), "捐兵-消息列表")
        .when(has("捐赠确认按钮"), "捐兵-增援确认")
        .when(any_of("下一个按钮", "搜索对手按钮"), "搜索中")
        .when(has("返回按钮"), "战斗结束")
        .when(any_of("结束战斗按钮", *vocab.RESOURCE_CLASSES), "战斗中")
        .when(any_of("进攻按钮", "增援按钮"), "村庄待机")
    )


def infer_states(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """State per frame by its class set (at most 17 names); frames without boxes get NULL."""
    sets = boxes.groupBy("frame_id").agg(F.collect_set("type").alias("classes"))
    return (
        frames.select("frame_id").join(sets, "frame_id", "left")
        .select(
            "frame_id",
            state_of_classes(lambda n: F.coalesce(F.array_contains("classes", n), F.lit(False))).alias("state"),
        )
    )


def keep_classes(boxes: DataFrame, keep: dict[int, int]) -> DataFrame:
    """Only listed classes, with new ids."""
    return boxes.withColumn("new_id", vocab.lookup(F.col("class_id"), keep)).filter("new_id IS NOT NULL")


def background_quota(frames: DataFrame, keep_boxes: DataFrame, max_background: float, segments: int | None = None) -> DataFrame:
    """Frames in order; a frame without kept boxes stays while the number of such frames so far,
    skipped ones included, is at most ``max_background`` x max(1, frames kept so far).

    Both running numbers of frames with and without boxes are plain sums. What is left is the number a of kept backgrounds, which rises by one at
    a row if it has reached that row's need. A block of rows is a step function of the a it starts from: each row has the smallest
    start at which it is kept. One pass finds these steps for all blocks at once, one takes the steps of a split's blocks in order.
    """
    n = keep_boxes.groupBy("frame_id").agg(count_rows("n_boxes"))
    rows = frames.select("split", "frame_id").join(n, "frame_id", "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)).cast("bigint"))
    bare = F.col("n_boxes") == 0
    o = ordered(rows, ["split"], ["frame_id"], segments).running_sum("_bg", bare.cast("bigint"))
    o = o.running_sum("_boxed", (~bare).cast("bigint"))
    # the smallest number of kept frames that allows this background; the quotient is set right by the test itself
    b, q = F.col("_bg"), F.lit(float(max_background))
    near = F.ceil(b / q).cast("bigint")
    allows = lambda k: b <= q * F.greatest(F.lit(1), k)
    least = F.when(allows(F.lit(0)), 0).when(allows(near - 1), near - 1).when(allows(near), near).otherwise(near + 1)
    # without any allowance nothing is kept; greatest() would turn a NULL need into 0
    need = F.when(bare, F.greatest(F.lit(0), least - F.col("_boxed"))) if max_background > 0 else F.lit(None)
    need = need.cast("bigint")
    rows = o.df.select("split", "frame_id", "n_boxes", need.alias("_need"), F.when(bare, b - 1).alias("_most"), SEG)
    stepped = materialise(rows.repartition("split", SEG).sortWithinPartitions("split", SEG, "frame_id").mapInArrow(_steps, "split string, frame_id long, n_boxes long, _seg int, _block long, _from long"))
    block = ["split", SEG, "_block"]
    steps = stepped.filter("_from IS NOT NULL").groupBy(*block).agg(F.array_sort(F.collect_list("_from")).alias("_steps"))
    starts = in_order(steps, ["split"], [SEG, "_block"], _block_starts, "split string, _seg int, _block long, _at long")
    kept = (F.col("n_boxes") > 0) | F.coalesce(F.col("_at") >= F.col("_from"), F.lit(False))
    return join_segments(stepped, starts, block).select("split", "frame_id", "n_boxes", kept.alias("kept"))


#: Rows of a block of ``background_quota``.
BLOCK = 32_768


def _steps(batches):
    """For each background the smallest number of kept ones, at its block's start, with which it is kept (NULL: none that can be)."""
    group, steps, size, block = None, [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, group = group_starts(batch, ["split", SEG], group)
        blocks, found = [], []
        for new, need, most in zip(starts.tolist(), batch.column("_need").to_pylist(), batch.column("_most").to_pylist(), strict=True):
            if new or size >= BLOCK:
                steps, size, block = [], 0, 0 if new else block + 1
            size += 1
            at = None
            if need is not None:
                # smallest start a with a + (steps up to a) >= need: a lies between two steps, or is one of them
                low, high = 0, len(steps)
                while low < high:
                    mid = (low + high) // 2
                    if steps[mid] + mid + 1 >= need:
                        high = mid
                    else:
                        low = mid + 1
                at = max(0, need - low) if low == len(steps) else max(0, min(steps[low], need - low))
                if at > most:
                    at = None  # not even with every background before it kept
                else:
                    insort(steps, at)
            blocks.append(block)
            found.append(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("split"), batch.column("frame_id").cast(pa.int64()), batch.column("n_boxes"), batch.column(SEG), pa.array(blocks, pa.int64()), pa.array(found, pa.int64())],
            names=["split", "frame_id", "n_boxes", SEG, "_block", "_from"],
        )


def _block_starts(batches):
    """Backgrounds kept before each block, from the steps of the blocks before it: one block at a time."""
    group, kept = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, group = group_starts(batch, ["split"], group)
        at = []
        for i, new in enumerate(starts.tolist()):
            kept = 0 if new else kept
            at.append(kept)
            kept += int(np.searchsorted(np.asarray(batch.column("_steps")[i].values), kept, side="right"))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("split", SEG, "_block")), pa.array(at, pa.int64())], names=["split", SEG, "_block", "_at"])


def triage(frames: DataFrame, boxes: DataFrame, keep_conf: float, floor_conf: float, reviewer: bool) -> DataFrame:
    """Frame fate by its detections: keep, review, negative or dropped."""
    per_frame = boxes.filter(F.col("confidence") >= floor_conf).groupBy("frame_id").agg(
        F.count_if(F.col("confidence") >= keep_conf).alias("n_high"), count_rows("n_all")
    )
    high, all_ = F.coalesce("n_high", F.lit(0)), F.coalesce("n_all", F.lit(0))
    return frames.select("frame_id").join(per_frame, "frame_id", "left").select(
        "frame_id",
        high.alias("n_high"),
        F.when(high > 0, "keep")
        .when((all_ > 0) & F.lit(reviewer), "review")
        .when(all_ == 0, "negative")
        .otherwise("dropped")
        .alias("fate"),
    )


def first_writer_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of parts in which a key of an earlier part hides the same key of later parts."""
    tagged = [p.withColumn("part_no", F.lit(i)) for i, p in enumerate(parts)]
    union = reduce(DataFrame.unionByName, tagged)
    payload = [c for c in union.columns if c not in key]
    first = union.groupBy(*key).agg(F.min_by(F.struct(*payload), "part_no").alias("_p"))
    return first.select(*key, *[F.col("_p")[c].alias(c) for c in payload])


def images_with_labels(images: DataFrame, labels: DataFrame, stem: str) -> DataFrame:
    """Images with their label file by (``stem``, ``source``); of images with one name the first source that has both wins."""
    both = images.join(labels, [stem, "source"])
    rest = [c for c in both.columns if c not in (stem, "source")]
    first = both.groupBy(stem).agg(F.min_by(F.struct("source", *rest), "source").alias("_first"))
    return first.select(stem, "_first.*")
