"""Column functions on points and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def centre(a: Column, b: Column) -> Column:
    """Integer midpoint, fractions dropped towards zero."""
    return ((a + b) / 2).cast("int")


def normalised(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Corner box in pixels to centre, width and height as image fractions."""
    return F.struct(
        ((x1 + x2) / 2 / w).alias("cx"),
        ((y1 + y2) / 2 / h).alias("cy"),
        ((x2 - x1) / w).alias("bw"),
        ((y2 - y1) / h).alias("bh"),
    )


def add_clamped(df: DataFrame, out: str, cx: Column, cy: Column, bw: Column, bh: Column) -> DataFrame:
    """Normalised box pushed inside the image; a box keeps at least 1e-6 of extent.

    Stages are separate projections so that each value is computed once.
    """
    one = F.lit(1.0)
    return (
        df.withColumns({"_cx": cx, "_cy": cy, "_bw": clamp(bw, F.lit(1e-6), one), "_bh": clamp(bh, F.lit(1e-6), one)})
        .withColumns({
            "_cx": clamp(F.col("_cx"), F.col("_bw") / 2, one - F.col("_bw") / 2),
            "_cy": clamp(F.col("_cy"), F.col("_bh") / 2, one - F.col("_bh") / 2),
        })
        .withColumn(out, F.struct(*[F.col("_" + c).alias(c) for c in ("cx", "cy", "bw", "bh")]))
        .drop("_cx", "_cy", "_bw", "_bh")
    )


def fixed_text(v: Column, digits: int = 6) -> Column:
    """Decimal text of the exact binary value, ties to even."""
    return F.replace(F.format_number(v, digits), F.lit(","), F.lit(""))


def fraction_text(v: Column) -> Column:
    """``fixed_text`` with six decimals, by whole numbers where the rounding is sure: a small positive value that is not near a tie."""
    micro = v * F.lit(1e6)
    sure = (v > 0) & (v < 1000) & (F.abs(micro - F.floor(micro) - 0.5) > 1e-4)
    n = F.rint(micro).cast("bigint")
    decimals = (n % 1_000_000 + 1_000_000).cast("string").substr(2, 6)
    return F.when(sure, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("."), decimals)).otherwise(fixed_text(v))


def round_half_even(v: Column, digits: int = 6) -> Column:
    """The number itself, rounded; text is made only where text is the result."""
    scale = F.lit(float(10**digits))
    return F.rint(v * scale) / scale


def box_line(class_id: Column, box: Column) -> Column:
    """Label text of a normalised box, six decimals."""
    nums = F.transform(F.array(*[box[f] for f in ("cx", "cy", "bw", "bh")]), fraction_text)
    return F.concat_ws(" ", class_id.cast("string"), nums)


def keep_when(df: DataFrame, cond: Column, out: str, value: Column) -> DataFrame:
    """Rows that meet ``cond``, with ``value``: a generator over zero or one element.

    A filter would be pushed below the staged projections and repeat all their expressions;
    a generator stays where it is and each stage is computed once.
    """
    return keep_value(df, out, F.when(cond, value))


def keep_value(df: DataFrame, out: str, value: Column) -> DataFrame:
    """Rows for which ``value`` is not NULL, with the value; see ``keep_when``."""
    staged = df.withColumn(out, value)
    return staged.select(*df.columns, F.explode(F.when(F.col(out).isNotNull(), F.array(out))).alias(out))


def add_clamped_to_image(
    df: DataFrame, out: str, x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column
) -> DataFrame:
    """Corner box cut to the image; the row goes when nothing is left.

    Swapped corners are not repaired: the left edge is lowered first and the right edge is
    then raised to it, so that such a box has no extent and is dropped.
    """
    c, zero = F.col, F.lit(0.0)
    box = F.struct(c("_l").alias("x1"), c("_t").alias("y1"), c("_x2").alias("x2"), c("_y2").alias("y2"))
    edges = (
        df.withColumns({"_x1": x1, "_y1": y1, "_x2": x2, "_y2": y2})
        .withColumns({
            "_l": F.greatest(zero, F.least(c("_x1"), c("_x2"))), "_t": F.greatest(zero, F.least(c("_y1"), c("_y2"))),
        })
        .withColumns({
            "_x2": F.least(w.cast("double"), F.greatest(c("_l"), c("_x2"))),
            "_y2": F.least(h.cast("double"), F.greatest(c("_t"), c("_y2"))),
        })
    )
    kept = keep_when(edges, (c("_x2") > c("_l")) & (c("_y2") > c("_t")), out, box)
    return kept.drop("_x1", "_y1", "_x2", "_y2", "_l", "_t")


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union of two corner boxes, 0 for an empty union."""
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1))
    ih = F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    inter = iw * ih
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def squared_distance(ax, ay, bx, by) -> Column:
    """As a 64-bit integer: exact, and comparable with a squared radius."""
    dx, dy = (ax - bx).cast("bigint"), (ay - by).cast("bigint")
    return dx * dx + dy * dy


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt(squared_distance(ax, ay, bx, by).cast("double"))


def _orient(px, py, qx, qy, rx, ry) -> Column:
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def _within(px, py, qx, qy, rx, ry) -> Column:
    return (
        (F.least(px, qx) <= rx) & (rx <= F.greatest(px, qx)) & (F.least(py, qy) <= ry) & (ry <= F.greatest(py, qy))
    )


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Do the segments ab and cd share a point (touching and collinear overlap count)?"""
    ax, ay, bx, by, cx, cy, dx, dy = (v.cast("bigint") for v in (ax, ay, bx, by, cx, cy, dx, dy))
    apart = (
        (F.greatest(ax, bx) < F.least(cx, dx))
        | (F.greatest(cx, dx) < F.least(ax, bx))
        | (F.greatest(ay, by) < F.least(cy, dy))
        | (F.greatest(cy, dy) < F.least(ay, by))
    )
    o1, o2 = _orient(cx, cy, dx, dy, ax, ay), _orient(cx, cy, dx, dy, bx, by)
    o3, o4 = _orient(ax, ay, bx, by, cx, cy), _orient(ax, ay, bx, by, dx, dy)
    touch = (
        ((o1 == 0) & _within(cx, cy, dx, dy, ax, ay))
        | ((o2 == 0) & _within(cx, cy, dx, dy, bx, by))
        | ((o3 == 0) & _within(ax, ay, bx, by, cx, cy))
        | ((o4 == 0) & _within(ax, ay, bx, by, dx, dy))
    )
    cross = ((o1 > 0) != (o2 > 0)) & ((o3 > 0) != (o4 > 0))
    return ~apart & (touch | cross)


def lines_meet(ab: tuple, cd: tuple) -> bool:
    """``segments_meet`` for plain whole numbers (ax, ay, bx, by)."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = ab, cd
    if max(ax, bx) < min(cx, dx) or max(cx, dx) < min(ax, bx) or max(ay, by) < min(cy, dy) or max(cy, dy) < min(ay, by):
        return False

    def side(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def on(px, py, qx, qy, rx, ry):
        return min(px, qx) <= rx <= max(px, qx) and min(py, qy) <= ry <= max(py, qy)

    o1, o2, o3, o4 = side(*cd, ax, ay), side(*cd, bx, by), side(*ab, cx, cy), side(*ab, dx, dy)
    touch = (o1 == 0 and on(*cd, ax, ay)) or (o2 == 0 and on(*cd, bx, by)) or (o3 == 0 and on(*ab, cx, cy)) or (o4 == 0 and on(*ab, dx, dy))
    return touch or ((o1 > 0) != (o2 > 0) and (o3 > 0) != (o4 > 0))


def cells_along(line: tuple, size: int):
    """Grid cells that a segment of whole numbers touches, column by column from its first end; cells may be named that it only comes near to."""
    ax, ay, bx, by = line
    first, last = ax // size, bx // size
    for gx in range(first, last + 1) if first <= last else range(first, last - 1, -1):
        if ax == bx:
            low, high = min(ay, by), max(ay, by)
        else:
            # the part of the line above this column, rounded outwards
            xs = [min(max(x, min(ax, bx)), max(ax, bx)) for x in (gx * size, (gx + 1) * size)]
            ys = [ay + (by - ay) * (x - ax) / (bx - ax) for x in xs]
            low, high = min(ys) - 1, max(ys) + 1
        for gy in range(int(low // size), int(high // size) + 1):
            yield gx, gy
