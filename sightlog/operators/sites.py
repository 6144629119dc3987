"""Sites: what a target is across frames, how often it was seen, and what is left of it.

A detection belongs to the first site of its name within reach, in the order in which sites were founded; without one it founds a site.
What a point belongs to is settled when the point is first seen, because later sites come later in that order. So the sorted detections of a
group are streamed past a grid of its founders, which lie more than the reach apart, and each carries its site on: they move once, and a task holds
a batch and the founders. Everything after that is grouping by site.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightlog.operators.segments import LARGE, by_groups, group_starts, in_order
from sightlog.session import materialise

MATCH_PX = 32


class Founders:
    """Founders of one group in a grid of cells of the reach."""

    def __init__(self, reach: int):
        self.reach, self.cells, self.n = reach, defaultdict(list), 0

    def site_of(self, x: int, y: int) -> tuple[int, int]:
        cx, cy = x // self.reach, y // self.reach
        first = None
        for i in (cx - 1, cx, cx + 1):
            for j in (cy - 1, cy, cy + 1):
                for no, fx, fy in self.cells.get((i, j), ()):
                    if (fx - x) ** 2 + (fy - y) ** 2 <= self.reach**2 and (first is None or no < first[0]):
                        first = no, fx, fy
        if first is None:
            self.cells[cx, cy].append((self.n, x, y))
            self.n += 1
            return x, y
        return first[1], first[2]


def with_sites(detections: DataFrame, keys: list[str], order: list[str], reach: int = MATCH_PX) -> DataFrame:
    """``detections`` (keys, x, y, order) with the founding point (site_x, site_y) of their site."""
    schema = T.StructType([*detections.schema.fields, T.StructField("site_x", T.IntegerType()), T.StructField("site_y", T.IntegerType())])

    def run(batches):
        group, founders = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, group = group_starts(batch, keys, group)
            found = []
            for new, x, y in zip(starts.tolist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if new:
                    founders = Founders(reach)
                found.append(founders.site_of(x, y))
            at = np.asarray(found, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at[:, 0]), pa.array(at[:, 1])], names=schema.names)

    return in_order(detections, keys, order, run, schema)


def site_memory(
    detections: DataFrame, keys: list[str], order: list[str], capacity: Column, step: str, segments=None, together: bool = False, large: int = LARGE,
) -> DataFrame:
    """Times seen so far, largest capacity so far and step of the last sighting of the site of each detection.

    Steps rise along the order, so the row's own one is the last. ``together``: detections of equal ``order`` are seen at once, and each has
    what is known of its site after them.
    """
    def observe(o):
        return o.row_number("times_seen").running_max("max_capacity", F.col("_cap"))

    # read for the size of its groups as well: stored, so that sites are found once
    stored = materialise(detections.withColumn("_cap", capacity))
    seen = by_groups(stored, [*keys, "site_x", "site_y"], order, observe, segments, large, together)
    return seen.drop("_cap").withColumn("last_seen", F.col(step))


def depletion(capacity: Column, deploys: Column, seen: Column, wall: Column, walk: Column, per_troop: int = 1000, min_seen: int = 2) -> dict[str, Column]:
    looted = F.when(deploys <= 0, 0).otherwise(F.least(capacity, F.greatest(F.lit(0), deploys - wall - walk) * per_troop))
    remaining = F.greatest(F.lit(0), capacity - looted)
    needed = F.when(capacity <= 0, 0).otherwise(F.ceil(capacity / per_troop) + wall + walk)
    return {
        "looted": looted, "remaining": remaining, "needed": needed,
        "depleted": (seen >= min_seen) & ((remaining <= 0) | (deploys >= needed)),
    }
