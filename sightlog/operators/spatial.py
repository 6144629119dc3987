"""Neighbours inside a frame: nearest points, first point in reach, lines that meet.

Points are made distinct first: a frame has at most as many distinct points as its canvas has pixels, whatever the
number of rows. Nearest points come from a distance transform of each frame: per row of the canvas that is asked for,
the nearest point of every column, then per asked point the nearest of those. Its work is bounded by the canvas (rows
x points + points x columns), where pairs of points would grow with the square. The other joins use the frame and a grid
cell as key, so a point meets only points around it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog.functions import geometry as g
from sightlog.operators.segments import group_starts, in_order


def _cell(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("int")


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(_cell(low, size), _cell(high, size)))


def within_reach(left: DataFrame, right: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Pairs of rows of ``left`` (x, y) and ``right`` (px, py) at most ``radius`` apart, with ``d2``.

    The cell edge is twice the radius, so a right point is listed in one to four cells.
    """
    size = 2 * radius
    r = right.withColumn("_gx", _cells(F.col("px") - radius, F.col("px") + radius, size)).withColumn(
        "_gy", _cells(F.col("py") - radius, F.col("py") + radius, size)
    )
    l = left.withColumn("_gx", _cell(F.col("x"), size)).withColumn("_gy", _cell(F.col("y"), size))
    d2 = g.squared_distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    return l.join(r, keys + ["_gx", "_gy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop("_gx", "_gy")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the optimiser would inline it into a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def neighbours(points: DataFrame, keys: list[str], asked: str, radii: dict[str, int]) -> DataFrame:
    """Nearest points of several roles around each distinct point of the role ``asked``, in one pass over ``points`` (keys, role, x, y).

    One row (keys, x, y) per asked point, with a struct (d2, py, px) for each role of ``radii``, NULL beyond its radius, and
    ``has_<role>``: whether the group has any point of it. Ties go to the smallest (py, px).
    """
    c = F.col
    square = lambda v: v.cast("bigint") * v.cast("bigint")
    sets = [F.collect_set(F.when(c("role") == asked, F.struct("y", "x"))).alias("_asked")]
    sets += [F.collect_set(F.when(c("role") == r, F.struct("x", "y"))).alias(r) for r in radii]
    frames = points.groupBy(*keys).agg(*sets).filter(F.size("_asked") > 0)

    def by_column(r):
        xs = F.array_distinct(F.transform(c(r), lambda p: p["x"]))
        ys = lambda x: F.transform(F.filter(c(r), lambda p: p["x"] == x), lambda p: p["y"])
        return F.transform(xs, lambda x: F.struct(x.alias("x"), ys(x).alias("ys"))).alias(r)

    def in_row(columns, y0):
        to = lambda k: F.transform(k["ys"], lambda y: F.struct(square(y - y0).alias("d"), y.alias("py"), k["x"].alias("px")))
        return F.transform(columns, lambda k: F.array_min(to(k)))

    def to_point(row, x0):
        return F.array_min(F.transform(row, lambda q: F.struct((q["d"] + square(q["px"] - x0)).alias("d2"), q["py"].alias("py"), q["px"].alias("px"))))

    def row_of(v, y0):
        rows = F.struct(*[in_row(v[r], y0).alias(r) for r in radii])
        return _let(rows, lambda row: F.transform(
            F.filter(c("_asked"), lambda p: p["y"] == y0),
            lambda p: F.struct(p["x"].alias("x"), y0.alias("y"), *[to_point(row[r], p["x"]).alias(r) for r in radii]),
        ))

    rows = F.array_distinct(F.transform(c("_asked"), lambda p: p["y"]))
    all_points = _let(F.struct(*[by_column(r) for r in radii]), lambda v: F.flatten(F.transform(rows, lambda y0: row_of(v, y0))))
    some = [(F.size(r) > 0).alias(f"has_{r}") for r in radii]
    found = frames.select(*keys, *some, F.explode(all_points).alias("_p"))
    return found.select(
        *keys, "_p.x", "_p.y", *[f"has_{r}" for r in radii],
        *[F.when(c("_p")[r]["d2"] <= radius * radius, c("_p")[r]).alias(r) for r, radius in radii.items()],
    )


def nearest(left: DataFrame, right: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Nearest right point within ``radius`` of each distinct left point: (keys, x, y, d2, px, py)."""
    point = [*keys, "x", "y"]
    both = left.select(*point, F.lit("asked").alias("role")).unionByName(right.select(*point, F.lit("near").alias("role")))
    found = neighbours(both, keys, "asked", {"near": radius}).filter("near IS NOT NULL")
    return found.select(*point, "near.d2", "near.px", "near.py")


def first_in_reach(
    left: DataFrame, right: DataFrame, keys: list[str], radius: int, order: str, payload: list[str]
) -> DataFrame:
    """For each distinct left point the first right row, by ``order``, within ``radius`` (not the nearest)."""
    point = keys + ["x", "y"]
    value = F.struct(order, *payload)
    # of rows at one place only the first can be chosen
    other = right.groupBy(*keys, F.col("x").alias("px"), F.col("y").alias("py")).agg(F.min_by(value, order).alias("v"))
    pairs = within_reach(left.select(*point).distinct(), other, keys, radius)
    hit = pairs.groupBy(*point).agg(F.min_by("v", F.col("v")[order]).alias("v"))
    return hit.select(*point, *[F.col("v")[c].alias(c) for c in [order, *payload]])


def crossing_layers(routes: DataFrame, walls: DataFrame, keys: list[str], cap: int = 2, size: int = 64) -> DataFrame:
    """Walls that each route (x, y) -> (px, py) meets, counted up to ``cap``; routes that meet none are left out.

    Equal walls are one row with their number. A group's walls pass its task before its routes and lie in the grid cells that their line
    touches; a route is followed cell by cell and ends at the ``cap``-th wall, so no pairs are listed and a crowded frame stops early.
    The task holds the distinct walls of a group.
    """
    ends = ["a", "b", "c", "d"]
    columns = lambda names: [F.col(n).cast("long").alias(e) for n, e in zip(names, ends, strict=True)]
    w = walls.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.least(F.count(F.lit(1)), F.lit(cap)).cast("int").alias("copies"))
    rows = w.select(*keys, F.lit(0).alias("_kind"), *columns(("x1", "y1", "x2", "y2")), "copies").unionByName(
        routes.select(*keys, "x", "y", "px", "py").distinct().select(*keys, F.lit(1).alias("_kind"), *columns(("x", "y", "px", "py")), F.lit(0).alias("copies"))
    ).dropna(subset=ends)
    route = [*keys, "x", "y", "px", "py"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in routes.select(*route).schema.fields), "layers int"])
    types = {c: _to_arrow(routes.schema[c].dataType) for c in ("x", "y", "px", "py")}

    def run(batches):
        group, grid = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, group = group_starts(batch, keys, group)
            at, layers = [], []
            for i, (new, kind, copies, *line) in enumerate(zip(starts.tolist(), *(batch.column(c).to_pylist() for c in ("_kind", "copies", *ends)), strict=True)):
                if new:
                    grid = {}
                line = tuple(line)
                if kind == 0:
                    for cell in g.cells_along(line, size):
                        grid.setdefault(cell, []).append((line, copies))
                elif n := _layers(line, grid, cap, size):
                    at.append(i)
                    layers.append(n)
            met = batch.take(pa.array(at, pa.int64()))
            values = [met.column(e).cast(types[c]) for e, c in zip(ends, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(met.column(k) for k in keys), *values, pa.array(layers, pa.int32())], names=[*route, "layers"])

    return in_order(rows, keys, ["_kind"], run, schema)


def _to_arrow(kind) -> pa.DataType:
    return pa.int64() if kind.simpleString() == "bigint" else pa.int32()


def _layers(line: tuple, grid: dict, cap: int, size: int) -> int:
    n, seen = 0, set()
    for cell in g.cells_along(line, size) if grid else ():
        for wall, copies in grid.get(cell, ()):
            if wall not in seen and g.lines_meet(line, wall):
                seen.add(wall)
                n += copies
                if n >= cap:
                    return cap
    return n
