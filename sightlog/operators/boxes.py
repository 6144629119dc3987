"""Box operators: parsing, clamping, rescaling and cross-source duplicate removal."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.functions import text as tx
from sightlog.operators.segments import group_starts, in_order

LEGACY = (1280.0, 960.0)
LOGICAL = (1280, 720)


def numbers_only(tokens: Column) -> Column:
    """Whether every token is a finite number."""
    return F.forall(tokens, lambda t: F.coalesce(F.abs(t.try_cast("double")) < float("inf"), F.lit(False)))


def parse_label_lines(lines: DataFrame, rounding: str = "truncate") -> DataFrame:
    """Label text (path, w, h, line) to pixel boxes; lines without five numbers are dropped.

    ``truncate`` cuts fractions, ``round`` rounds half to even.
    """
    v = lambda i: F.get("_t", F.lit(i)).try_cast("double")
    to_int = (lambda c: c.try_cast("int")) if rounding == "truncate" else (lambda c: F.rint(c).try_cast("int"))
    split = lines.withColumn("_s", F.split(tx.strip(F.col("line")), r"\s+"))
    tokens = g.keep_when(split, (F.size("_s") == 5) & numbers_only(F.col("_s")), "_t", F.col("_s"))
    return tokens.select(
        *[c for c in lines.columns if c != "line"],
        v(0).try_cast("int").alias("class_id"),
        to_int((v(1) - v(3) / 2) * F.col("w")).alias("x1"),
        to_int((v(2) - v(4) / 2) * F.col("h")).alias("y1"),
        to_int((v(1) + v(3) / 2) * F.col("w")).alias("x2"),
        to_int((v(2) + v(4) / 2) * F.col("h")).alias("y2"),
    )


def clamp_label_lines(lines: DataFrame) -> DataFrame:
    """Clamped text of lines with five numbers; other lines stay as they are, blank ones go."""
    v = lambda i: F.get("_t", F.lit(i)).try_cast("double")
    stripped = lines.withColumn("_s", tx.strip(F.col("line")))
    tokens = g.keep_when(stripped, F.col("_s") != "", "_text", F.col("_s")).drop("_s").withColumn("_t", F.split("_text", r"\s+"))
    fixed = F.when((F.size("_t") == 5) & numbers_only(F.col("_t")), g.box_line(v(0).try_cast("int"), F.col("_b")))
    return (
        g.add_clamped(tokens, "_b", v(1), v(2), v(3), v(4))
        .withColumn("fixed", F.coalesce(fixed, F.col("line")))
        .withColumn("changed", F.col("fixed") != F.col("_text"))
        .drop("_t", "_b", "_text")
    )


def add_legacy_box(objects: DataFrame, out: str, w: Column, h: Column) -> DataFrame:
    """Teacher (bbox, coords, type) to pixels: fractions if all values are in [0, 1], else the old
    fixed canvas; without a usable box, a prior box around the point."""
    c = F.col
    names = ["_v0", "_v1", "_v2", "_v3"]
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    both = lambda conds: reduce(lambda a, b: a & b, conds)
    pw, ph = vocab.prior_size(c("type"))
    is_box = F.coalesce(both([finite(F.get("bbox", F.lit(i))) for i in range(4)]), F.lit(False))
    value = lambda i: F.when(c("_isbox"), F.get("bbox", F.lit(i))).otherwise(
        F.get("coords", F.lit(i % 2))
    )
    # fractions of the image, or pixels of the old canvas; a point stands in for both corners
    scale = lambda n, size, legacy: F.when(c("_u"), c(n) * size).otherwise(c(n) * size / F.lit(legacy))
    staged = (
        objects.withColumn("_isbox", is_box)
        .withColumns({n: value(i) for i, n in enumerate(names)})
        .withColumn("_u", both([c(n).between(0, 1) for n in names]))
        .withColumns({
            "_v0": scale("_v0", w, LEGACY[0]), "_v1": scale("_v1", h, LEGACY[1]),
            "_v2": scale("_v2", w, LEGACY[0]), "_v3": scale("_v3", h, LEGACY[1]),
            "_pw": F.when(c("_isbox"), 0.0).otherwise(pw * w / 2), "_ph": F.when(c("_isbox"), 0.0).otherwise(ph * h / 2),
        })
    )
    return g.add_clamped_to_image(
        staged, out, c("_v0") - c("_pw"), c("_v1") - c("_ph"), c("_v2") + c("_pw"), c("_v3") + c("_ph"), w, h
    ).drop("_isbox", "_u", "_pw", "_ph", *names)


def add_teacher_box(objects: DataFrame, out: str, w: Column, h: Column) -> DataFrame:
    """Teacher (bbox, coords, type) to a normalised box, each corner clamped on its own; else
    point and prior size."""
    at = lambda a, i: F.get(a, F.lit(i))
    zero, wd, hd = F.lit(0.0), w.cast("double"), h.cast("double")
    c = F.col
    pw, ph = vocab.prior_size(c("type"))
    staged = objects.withColumns({
        "_x1": g.clamp(at("bbox", 0), zero, wd), "_x2": g.clamp(at("bbox", 2), zero, wd),
        "_y1": g.clamp(at("bbox", 1), zero, hd), "_y2": g.clamp(at("bbox", 3), zero, hd),
        "_px": at("coords", 0), "_py": at("coords", 1), "_pw": pw, "_ph": ph,
    })
    given = reduce(lambda a, b: a & b, [at("bbox", i).isNotNull() for i in range(4)])
    usable = given & (c("_x2") > c("_x1")) & (c("_y2") > c("_y1")) & (c("_x1") < wd) & (c("_y1") < hd)
    inside = (F.size("coords") >= 2) & (c("_px") >= 0) & (c("_px") < wd) & (c("_py") >= 0) & (c("_py") < hd)
    box = F.struct(
        ((c("_x1") + c("_x2")) / 2 / w).alias("cx"), ((c("_y1") + c("_y2")) / 2 / h).alias("cy"),
        F.least((c("_x2") - c("_x1")) / w, F.lit(1.0)).alias("bw"), F.least((c("_y2") - c("_y1")) / h, F.lit(1.0)).alias("bh"),
    )
    point = F.struct((c("_px") / w).alias("cx"), (c("_py") / h).alias("cy"), c("_pw").alias("bw"), c("_ph").alias("bh"))
    # a usable box or a point inside the image; other objects go
    return g.keep_when(staged, usable | inside, out, F.when(usable, box).otherwise(point)).drop(
        "_x1", "_x2", "_y1", "_y2", "_px", "_py", "_pw", "_ph"
    )


def logical_point_boxes(
    objects: DataFrame, min_conf: float = 0.5, box_scale: float = 1.0
) -> DataFrame:
    """(type, confidence, x, y, w, h) on the logical canvas to normalised prior boxes.

    Kept are farm classes with enough confidence whose point lies strictly inside.
    """
    c, w, h, zero = F.col, F.col("w"), F.col("h"), F.lit(0.0)
    pw, ph = vocab.prior_size(c("type"), vocab.FARM_PRIOR_BOX)
    return (
        objects.withColumn("farm_id", vocab.class_id_of(c("type"), vocab.FARM_CLASSES))
        .filter(c("farm_id").isNotNull())
        .filter(F.coalesce(c("confidence"), zero) >= min_conf)
        .filter("x > 0 AND y > 0")
        .withColumns({
            "_cx": c("x") / LOGICAL[0] * w, "_cy": c("y") / LOGICAL[1] * h,
            "_bw": pw * box_scale * w, "_bh": ph * box_scale * h,
        })
        .filter("_cx > 0 AND _cx < w AND _cy > 0 AND _cy < h")
        .withColumns({
            "_x1": F.greatest(zero, c("_cx") - c("_bw") / 2), "_y1": F.greatest(zero, c("_cy") - c("_bh") / 2),
            "_x2": F.least(w.cast("double"), c("_cx") + c("_bw") / 2),
            "_y2": F.least(h.cast("double"), c("_cy") + c("_bh") / 2),
        })
        .transform(lambda df: g.keep_when(
            df, F.expr("_x2 > _x1 AND _y2 > _y1"), "box", g.normalised(c("_x1"), c("_y1"), c("_x2"), c("_y2"), w, h)
        ))
        .drop("_cx", "_cy", "_bw", "_bh", "_x1", "_y1", "_x2", "_y2")
    )


def ocr_boxes(
    results: DataFrame,
    w: int,
    h: int,
    pad: int = 12,
    min_conf: float = 0.5,
    prior_mode: bool = False,
    extended: bool = False,
) -> DataFrame:
    """Recognised button text to normalised boxes.

    The box is the hull of the corner points, grown by ``pad`` pixels or, in prior mode, to
    max(2.2 x text width, prior width) by 1.4 x text height around its centre.
    """
    c = F.col
    xs = F.transform("bbox", lambda p: p["x"])
    ys = F.transform("bbox", lambda p: p["y"])
    cid = tx.any_button_class(c("text")) if extended else tx.button_class(c("text"))
    hits = (
        g.keep_value(results.filter(c("confidence") >= min_conf), "class_id", cid)
        .withColumns({"_l": F.array_min(xs), "_r": F.array_max(xs), "_t": F.array_min(ys), "_b": F.array_max(ys)})
    )
    if prior_mode:
        pw, _ = vocab.prior_size(vocab.class_name(c("class_id")))
        hits = hits.withColumns({
            "_hw": F.greatest((c("_r") - c("_l")) * 2.2, pw * w) / 2, "_hh": (c("_b") - c("_t")) * 1.4 / 2,
            "_cx": (c("_l") + c("_r")) / 2, "_cy": (c("_t") + c("_b")) / 2,
        })
        hull = {
            "x1": F.greatest(F.lit(0.0), c("_cx") - c("_hw")), "x2": F.least(F.lit(float(w)), c("_cx") + c("_hw")),
            "y1": F.greatest(F.lit(0.0), c("_cy") - c("_hh")), "y2": F.least(F.lit(float(h)), c("_cy") + c("_hh")),
        }
    else:
        hull = {
            "x1": F.greatest(F.lit(0), c("_l") - pad), "x2": F.least(F.lit(w), c("_r") + pad),
            "y1": F.greatest(F.lit(0), c("_t") - pad), "y2": F.least(F.lit(h), c("_b") + pad),
        }
    return (
        hits.withColumns(hull)
        .filter("x2 > x1 AND y2 > y1")
        .withColumn("box", g.normalised(c("x1"), c("y1"), c("x2"), c("y2"), F.lit(w), F.lit(h)))
        .drop("_l", "_r", "_t", "_b", "_hw", "_hh", "_cx", "_cy")
    )


class BoxGrid:
    """Boxes of one group, found by overlap (IoU over ``iou_over`` >= 0.5).

    Such boxes differ by less than a factor of two in size and by less than half of the smaller side in position. A box lies in the cell of its
    centre, on a grid that follows its size class; a search looks into three size classes and two cells per axis.
    """

    def __init__(self, iou_over: float):
        self.iou_over, self.cells = iou_over, defaultdict(list)

    def add(self, box: tuple, name) -> None:
        x1, y1, x2, y2 = box
        level = max(x2 - x1, y2 - y1, 1).bit_length()
        step = 2 << level
        self.cells[level, (x1 + x2) // step, (y1 + y2) // step].append((box, name))

    def overlapping(self, box: tuple):
        """(box, name) of those that overlap it."""
        x1, y1, x2, y2 = box
        area, level = (x2 - x1) * (y2 - y1), max(x2 - x1, y2 - y1, 1).bit_length()
        for lev in (level - 1, level, level + 1):
            size, step = 1 << lev, 2 << lev
            for gx in {(x1 + x2 - size) // step, (x1 + x2 + size) // step}:
                for gy in {(y1 + y2 - size) // step, (y1 + y2 + size) // step}:
                    for other, name in self.cells.get((lev, gx, gy), ()):
                        w, h = min(x2, other[2]) - max(x1, other[0]), min(y2, other[3]) - max(y1, other[1])
                        if w > 0 and h > 0:
                            both = w * h
                            if both > self.iou_over * (area + (other[2] - other[0]) * (other[3] - other[1]) - both):
                                yield other, name


SIDES = ("x1", "y1", "x2", "y2")


def overlapping_pairs(boxes: DataFrame, keys: list[str], rank: str, iou_over: float = 0.5) -> DataFrame:
    """(keys, a_rank, b_rank, iou): pairs of boxes of one group, the earlier one first, whose IoU exceeds ``iou_over`` (>= 0.5).

    The result is the pairs, so it grows with them; the search does not. Boxes of a group pass one task in order, next to a grid of
    those before them. ``rank`` is a BIGINT, total within a group; boxes without a side are left out.
    """
    sides = [F.col(c).cast("long").alias(c) for c in SIDES]
    rows = boxes.select(*keys, F.col(rank).cast("long").alias("b_rank"), *sides).dropna(subset=list(SIDES))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields), "a_rank long", "b_rank long", "iou double"])

    def run(batches):
        group, grid = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, group = group_starts(batch, keys, group)
            at, early, values = [], [], []
            for i, (new, no, *box) in enumerate(zip(starts.tolist(), *(batch.column(c).to_pylist() for c in ("b_rank", *SIDES)), strict=True)):
                if new:
                    grid = BoxGrid(iou_over)
                box = tuple(box)
                area = (box[2] - box[0]) * (box[3] - box[1])
                for o, name in grid.overlapping(box):
                    both = (min(box[2], o[2]) - max(box[0], o[0])) * (min(box[3], o[3]) - max(box[1], o[1]))
                    at.append(i)
                    early.append(name)
                    values.append(both / (area + (o[2] - o[0]) * (o[3] - o[1]) - both))
                grid.add(box, no)
                if len(at) >= 50_000:
                    yield pairs_of(batch, at, early, values)
                    at, early, values = [], [], []
            yield pairs_of(batch, at, early, values)

    def pairs_of(batch, at, early, values):
        late = batch.select([*keys, "b_rank"]).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*(late.column(k) for k in keys), pa.array(early, pa.int64()), late.column("b_rank"), pa.array(values, pa.float64())], names=[*keys, "a_rank", "b_rank", "iou"])

    return in_order(rows, keys, ["b_rank"], run, schema)


def merge_sources(
    boxes: DataFrame, keys: list[str], order: str, first: str, second: str, iou_over: float = 0.5
) -> DataFrame:
    """Boxes of ``first`` all stay; a box of ``second`` stays unless it overlaps a kept box of the
    same group that comes before it.

    Equal boxes are represented by their first copy, because later copies always go with it. The distinct boxes of a group pass one task
    in order, and a box meets only kept ones around it: kept boxes of ``second`` do not overlap, so few of them lie near any place, however
    many were near it. The task holds a grid of the kept boxes. A box without a side overlaps nothing and stays.
    """
    pool = boxes.filter(F.col("source").isin(first, second))
    payload = [c for c in boxes.columns if c not in (*keys, *SIDES)]
    rank = F.struct((F.col("source") != first).cast("int").alias("s"), F.col(order).alias("o"))
    # a box without a side is no copy of another
    alone = F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in SIDES]), F.col(order))
    distinct = pool.groupBy(*keys, *SIDES, alone.alias("_alone")).agg(F.min_by(F.struct(*payload), rank).alias("_p"), F.min(rank).alias("_rank"))
    rows = distinct.select(*keys, *SIDES, *[F.col("_p")[c].alias(c) for c in payload], F.col("_rank.s").alias("_s"), F.col("_rank.o").alias("_o"))
    names = boxes.columns
    out = rows.select(*names).schema

    def run(batches):
        group, grid = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, group = group_starts(batch, keys, group)
            kept = []
            for i, (new, s, *box) in enumerate(zip(starts.tolist(), *(batch.column(c).to_pylist() for c in ("_s", *SIDES)), strict=True)):
                if new:
                    grid = BoxGrid(iou_over)
                if None in box:
                    kept += [i] * s
                    continue
                box = tuple(box)
                if s and next(grid.overlapping(box), None) is not None:
                    continue
                grid.add(box, None)
                kept += [i] * s
            yield batch.select(names).take(pa.array(kept, pa.int64()))

    second_kept = in_order(rows, keys, ["_s", "_o"], run, out)
    return pool.filter(F.col("source") == first).unionByName(second_kept)
