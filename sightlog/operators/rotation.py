"""Target rotation with battle memory: one choice per tick, which the choices before it bear on.

All that does not depend on earlier choices is found in parallel: requested targets join the candidates, neighbours, scores, ways and walls
per candidate, the site of each candidate, and how often and with what capacity it had been seen by then. Candidates that no choice
could make accessible are dropped. What is left is folded in the order of ticks (``segments.in_order``): the state is the
last target with its run length and, per site that was hit, the number of hits and the costs of the last one. It is bounded by
the canvas, as sites of a name lie apart; a tick's candidates are held as distinct points.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.operators import scoring
from sightlog.operators.segments import group_starts, in_order
from sightlog.operators.sites import site_memory, with_sites
from sightlog.session import materialise

TARGET_PX, MAX_REPEATS, MIN_SEEN = 48, 2, 2
#: Place of a requested candidate in its frame: after all detections.
REQUESTED = (1 << 63) - 1

PLAN = (
    "session_id long, frame_id long, name string, x int, y int, land_x int, land_y int, score double, repeats int, reason string, "
    "n_candidates long, wall_cost int, walk_extra int, troops_needed long, expected_loot long"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _at(place: str, top: int) -> Column:
    return F.least(F.greatest(F.col(place), F.lit(0)), F.lit(top - 1)).alias(place[1])


def asked_places(requests: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(frame_id, name, x, y) of requests for a resource at a known place, moved inside the canvas."""
    known = requests.filter(F.col("r_name").isin(vocab.RESOURCE_CLASSES) & F.col("rx").isNotNull() & F.col("ry").isNotNull())
    return known.select("frame_id", F.col("r_name").alias("name"), _at("rx", size[0]), _at("ry", size[1]))


def add_requests(targets: DataFrame, requests: DataFrame, size: tuple[int, int], reach: int = TARGET_PX) -> DataFrame:
    """Targets (frame_id, det_no, name, x, y), and the requested place (r_name, rx, ry) of frames that have no target of that name in reach of it.

    Rows move once, by frame, where each target is compared with the few places that are asked for. Further columns are NULL for a requested place.
    """
    c = F.col
    asked = asked_places(requests, size).withColumn("det_no", F.lit(REQUESTED))
    rows = targets.withColumn("_new", F.lit(False)).unionByName(asked.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    frame = Window.partitionBy("frame_id")
    rows = rows.withColumn("_places", F.collect_set(F.when(c("_new"), F.struct("name", "x", "y"))).over(frame))
    meets = F.exists("_places", lambda p: (p["name"] == c("name")) & (g.squared_distance(c("x"), c("y"), p["x"], p["y"]) <= reach * reach))
    rows = rows.withColumn("_have", F.max(~c("_new") & c("frame_id").isNotNull() & meets).over(frame))
    return rows.filter(~(c("_new") & F.coalesce("_have", F.lit(False)))).drop("_new", "_places", "_have")


def candidates(
    targets: DataFrame, frames: DataFrame, requests: DataFrame, points: DataFrame, walls: DataFrame, full: DataFrame, size: tuple[int, int], cfg: dict = scoring.LOOT,
) -> DataFrame:
    """Candidates of each tick that a choice may fall on, with score, costs, site and the site's memory at the end of the tick's observation.

    ``targets`` carries ``cap``, ``frames`` is (frame_id, session_id, step), ``points`` as ``scoring.with_neighbours`` takes them.

    Every candidate is observed, also one that is not open to a choice, so all rows pass sites and memory. They move once by frame, once by session and
    once by site; what lies around a candidate goes with it only if a choice may fall on it, and all later steps have only such rows.
    """
    c = F.col
    # a capacity holds for each row of its number in the frame
    same = Window.partitionBy("frame_id", "det_no")
    rows = add_requests(targets.withColumn("_own", F.struct("cap")).drop("cap"), requests, size)
    caps = F.when(c("frame_id").isNotNull() & c("det_no").isNotNull(), F.collect_list("_own").over(same))
    rows = rows.withColumn("_caps", caps).select("frame_id", "det_no", "name", "x", "y", F.explode_outer("_caps").alias("_own"))
    rows = rows.withColumn("cap", F.coalesce("_own.cap", vocab.lookup(c("name"), vocab.CAPACITY, vocab.DEFAULT_CAPACITY))).drop("_own").join(frames, "frame_id")
    # places that are no candidates, as a target is near them, ask for neighbours that no row takes
    asked = asked_places(requests, size).select("frame_id", F.lit("target").alias("role"), "x", "y")
    may = (scoring.landing_px() <= cfg["max_px"]) & (scoring.landing_risk() <= cfg["max_risk"])
    near = scoring.with_neighbours(rows, points.unionByName(asked), only=may)
    around = F.when(c("has_landable"), F.struct("defence_px", "landable"))
    near = near.withColumn("around", around).drop("defence_px", "landable", "has_landable")
    placed = with_sites(near, ["session_id", "name"], ["frame_id", "det_no"])
    seen = site_memory(placed, ["session_id", "name"], ["frame_id"], c("cap"), "step", together=True)
    able = seen.filter("around IS NOT NULL AND session_id IS NOT NULL").select(
        "session_id", "frame_id", "det_no", "name", "x", "y", "site_x", "site_y", c("times_seen").alias("seen"), c("max_capacity").cast("long").alias("capacity"), "around.*",
        F.lit(True).alias("has_landable"),
    )
    able = scoring.skip_full(able, full).join(requests, "frame_id", "left")
    # routes and costs both start from it
    costs = scoring.approach(materialise(scoring.score_targets(able, size)), walls, cfg)
    able = costs.filter((c("dist") <= cfg["max_px"]) & (c("wall_cost") <= cfg["wall_limit"]) & (c("risk") <= cfg["max_risk"]))
    apart = (c("x") - c("rx")).cast("long") * (c("x") - c("rx")) + (c("y") - c("ry")).cast("long") * (c("y") - c("ry"))
    return able.select(
        "session_id", "frame_id", "det_no", "name", "x", "y", "score", "site_x", "site_y", "seen", "capacity", "px", "py",
        "wall_cost", "walk_extra", "loot_factor", F.coalesce((c("name") == c("r_name")) & (apart <= TARGET_PX**2), F.lit(False)).alias("asked"), "r_name",
    )


class Memory:
    """Choices so far of one session."""

    def __init__(self):
        self.last, self.repeats, self.hits = None, 0, {}

    def same(self, a, b) -> bool:
        return a is not None and b is not None and a["name"] == b["name"] and math.dist((a["x"], a["y"]), (b["x"], b["y"])) <= TARGET_PX

    def estimate(self, c: dict, cfg: dict) -> dict | None:
        """Troops and loot for a candidate, or None if its site is emptied or the estimate does not allow it."""
        deploys, wall, walk, needed = self.hits.get((c["name"], c["site_x"], c["site_y"]), (0, 0, 0, None))
        per, cap = cfg["per_troop"], c["capacity"]
        left = max(0, cap - (min(cap, max(0, deploys - wall - walk) * per) if deploys else 0))
        if needed is None:
            needed = 0 if cap <= 0 else math.ceil(cap / per) + wall + walk
        if c["seen"] >= MIN_SEEN and (left <= 0 or deploys >= needed):
            return None
        base, cost = math.ceil(left / per), c["wall_cost"] + c["walk_extra"]
        loot = min(left, int(base * per * c["loot_factor"]), int(max(0, cfg["budget"] - cost) * per * c["loot_factor"]))
        if base + cost > cfg["budget"] or left <= 0 or loot < cfg["min_loot"]:
            return None
        return {"troops": base + cost, "loot": loot}

    def choose(self, tick: list[dict], n: int) -> tuple:
        """The plan for a tick's candidates, best first."""
        tired = lambda c: self.repeats >= MAX_REPEATS and self.same(c, self.last)
        asked = next((c for c in tick if c["asked"]), None)
        if asked is not None and not tired(asked):
            pick = asked
        else:
            pick = next((c for c in tick if not tired(c)), tick[0])
        # the estimate that counts is the best ranked one at the chosen place
        way = next(c for c in tick if self.same(c, pick))
        same = self.same(pick, self.last)
        before, self.repeats = self.repeats, self.repeats + 1 if same else 1
        if same and self.repeats >= MAX_REPEATS:
            reason = "repeat_limit_only_candidate" if n == 1 else "repeat_limit_reached"
        elif self.last is not None and not same and before >= MAX_REPEATS:
            reason = "rotated_after_repeat_limit"
        elif pick["r_name"] == pick["name"]:
            reason = "requested_target_honored"
        else:
            reason = "only_candidate" if n == 1 else "top_scored_target"
        self.last = pick
        site = pick["name"], pick["site_x"], pick["site_y"]
        self.hits[site] = (self.hits.get(site, (0,))[0] + 1, way["wall_cost"], way["walk_extra"], way["troops"])
        return (
            pick["session_id"], pick["frame_id"], pick["name"], pick["x"], pick["y"], way["px"], way["py"], pick["score"], self.repeats, reason, n,
            way["wall_cost"], way["walk_extra"], way["troops"], way["loot"],
        )


def rotate_targets(ranked: DataFrame, cfg: dict = scoring.LOOT) -> DataFrame:
    """One plan per tick that has a candidate worth it; ``ranked`` as ``candidates`` gives it."""
    names = [f.split()[0] for f in PLAN.split(", ")]
    types = [_ARROW[f.split()[1]] for f in PLAN.split(", ")]

    def run(batches):
        group, frame, memory, tick, places, n = None, None, None, [], set(), 0
        out = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, group = group_starts(batch, ["session_id"], group)
            for new, c in zip(starts.tolist(), batch.to_pylist(), strict=True):
                if new or c["frame_id"] != frame:
                    if tick:
                        out.append(memory.choose(tick, n))
                    tick, places, n, frame = [], set(), 0, c["frame_id"]
                if new:
                    memory = Memory()
                found = memory.estimate(c, cfg)
                if found is None:
                    continue
                n += 1
                if (c["name"], c["x"], c["y"]) not in places:
                    places.add((c["name"], c["x"], c["y"]))
                    tick.append(c | found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if tick:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(memory.choose(tick, n), types, strict=True)], names=names)

    lowest = ranked.withColumn("_order", -F.col("score"))
    return in_order(lowest, ["session_id"], ["frame_id", "_order", "det_no"], run, PLAN)
