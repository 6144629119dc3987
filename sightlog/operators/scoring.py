"""Target scores, loot estimates, feasibility, risk and validation of actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.operators import spatial
from sightlog.session import materialise

WEIGHTS = {"value": 0.40, "access": 0.35, "safety": 0.15, "distance": 0.10}
SAFE_PX = 200
REACH_PX = 120
LANDING_PX = 320

LOOT = {
    "per_troop": 1000, "budget": 30, "optimal_px": 120.0, "max_px": 260.0, "breaker": 3, "wall_limit": 6,
    "max_risk": 0.8, "min_loot": 400, "min_efficiency": 0.35, "walk_px": 180.0, "match_px": 24,
}


def with_neighbours(targets: DataFrame, points: DataFrame, safe_px: int = SAFE_PX, landing_px: int = LANDING_PX, only: Column | None = None) -> DataFrame:
    """Targets with what lies around them, from one pass over ``points`` (frame_id, role, x, y; roles target, defence, landable).

    Adds ``defence_px``: distance to the nearest defence, cut at ``safe_px`` (beyond it every score is the same), NULL in a frame
    without defences; ``landable``: struct (d2, py, px) of the nearest landable point within ``landing_px``; ``has_landable``. All three are NULL
    where ``only`` (over them) does not hold.
    """
    near = spatial.neighbours(points, ["frame_id"], "target", {"defence": safe_px, "landable": landing_px})
    far = F.coalesce(F.sqrt(F.col("defence")["d2"].cast("double")), F.lit(float(safe_px)))
    near = near.withColumn("defence_px", F.when(F.col("has_defence"), far)).select("frame_id", "x", "y", "defence_px", "landable", "has_landable")
    return targets.join(near, ["frame_id", "x", "y"]) if only is None else targets.join(near.filter(only), ["frame_id", "x", "y"], "left")


def skip_full(targets: DataFrame, status: DataFrame) -> DataFrame:
    """Targets whose own resource is not full yet. ``status`` is (frame_id, resource): full ones."""
    resource = vocab.lookup(F.col("name"), vocab.BUILDING_RESOURCE)
    return targets.withColumn("resource", resource).join(status, ["frame_id", "resource"], "left_anti").drop("resource")


def score_targets(targets: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Weighted score of value, accessibility, safety and distance to the deploy point.

    ``targets`` carries ``defence_px``. Accessibility follows the nearest landable point (``landable``, ``has_landable``), or the distance
    to the image edge in frames without any and where ``targets`` has no such columns.
    """
    w, h = size
    c = F.col
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    edge = F.least(c("x"), c("y"), w - c("x"), h - c("y"))
    access = 1.0 - F.least(F.lit(1.0), edge / (0.5 * min(w, h)))
    if "landable" in targets.columns:
        px = F.sqrt(c("landable")["d2"].cast("double"))
        by_land = F.when(px.isNull(), 0.0).otherwise(unit(1.0 - px / float(REACH_PX)))
        access = F.when(c("has_landable"), by_land).otherwise(access)
    t = targets.withColumn("access", access)
    diagonal = float((w * w + h * h) ** 0.5)
    far = g.distance(c("x"), c("y"), F.lit(w // 2), F.lit(h - 10))
    t = t.withColumns({
        "value": vocab.lookup(c("name"), vocab.BASE_VALUE, vocab.DEFAULT_VALUE),
        "safety": F.when(c("defence_px").isNull(), 0.5).otherwise(F.least(F.lit(1.0), c("defence_px") / float(SAFE_PX))),
        "distance": unit((F.lit(diagonal) - far) / F.lit(diagonal)),
    })
    total = reduce(lambda a, b: a + b, [F.lit(k) * c(n) for n, k in WEIGHTS.items()])
    return t.withColumn("score", F.round(total, 6))


def rank_targets(scored: DataFrame, top_k: int | None = None) -> DataFrame:
    """Best first; equal scores keep the order of detection."""
    rn = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("score"), "det_no"))
    ranked = scored.withColumn("rank", rn.cast("bigint"))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def landing_px() -> Column:
    """Distance to the nearest landable point, NULL without one in reach."""
    return F.sqrt(F.col("landable")["d2"].cast("double"))


def landing_risk() -> Column:
    near = 1.0 - F.col("defence_px") / float(SAFE_PX)
    return F.when(F.col("defence_px").isNull(), 0.1).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), near)))


def approach(targets: DataFrame, walls: DataFrame, cfg: dict = LOOT) -> DataFrame:
    """What a landing at the nearest landable point costs: px, py, dist, wall_cost, walk_extra, loot_factor and risk, added to all columns of
    ``targets`` (frame_id, x, y, defence_px, landable). ``dist`` is NULL without a landable point in reach."""
    c, key = F.col, ["frame_id"]
    t = targets.withColumns({"px": c("landable")["px"], "py": c("landable")["py"], "dist": landing_px()})
    route = [*key, "x", "y", "px", "py"]
    layers = spatial.crossing_layers(t.filter("px IS NOT NULL").select(*route), walls, key)
    over = F.greatest(F.lit(0.0), c("dist") - cfg["optimal_px"])
    span = cfg["max_px"] - cfg["optimal_px"]
    return t.join(layers, route, "left").withColumns({
        "wall_cost": F.coalesce(c("layers") * cfg["breaker"], F.lit(0)),
        "risk": landing_risk(),
        "walk_extra": F.when(over > 0, F.ceil(over / cfg["walk_px"])).otherwise(0).cast("int"),
        "loot_factor": F.when(over > 0, F.greatest(F.lit(0.35), 1.0 - F.least(F.lit(1.0), over / span) * 0.8)).otherwise(1.0),
    }).drop("layers")


def estimate_loot(targets: DataFrame, walls: DataFrame, known: DataFrame | None = None, cfg: dict = LOOT) -> DataFrame:
    """Loot estimate per target (frame_id, det_no, name, x, y, defence_px, landable, and optionally level); all columns of ``targets`` stay.

    A target without a landable point in reach has no allowed place. ``known`` lists boxes with a
    capacity and a looted amount; the first of the same name within reach is used.
    """
    c = F.col
    kept = targets.columns
    # routes, known boxes and the estimate itself read the targets: stored, so that neighbours are looked for once
    targets = materialise(targets)
    t = approach(targets, walls, cfg)
    default = vocab.lookup(c("name"), vocab.CAPACITY, vocab.DEFAULT_CAPACITY)
    if "level" in targets.columns:
        scaled = (default * (F.lit(0.8) + 0.15 * F.greatest(F.lit(1), c("level")))).cast("int")
        # greatest() skips NULL, so an unknown level has to be kept out by hand
        default = F.when(c("level").isNull(), default).otherwise(scaled)
    if known is not None:
        match = spatial.first_in_reach(targets, known, ["frame_id", "name"], cfg["match_px"], "det_no", ["capacity", "looted"])
        t = t.join(match.drop("det_no"), ["frame_id", "name", "x", "y"], "left")
        capacity, looted = F.coalesce("capacity", default), F.coalesce("looted", F.lit(0))
    else:
        capacity, looted = default, F.lit(0)
    t = t.withColumn("remaining", F.greatest(F.lit(0), capacity - looted).cast("bigint"))
    t = t.withColumn("base", F.ceil(c("remaining") / cfg["per_troop"]).cast("int")).withColumns({
        "troops_needed": c("base") + c("wall_cost") + c("walk_extra"),
        "expected_loot": F.least(
            c("remaining"),
            (c("base") * cfg["per_troop"] * c("loot_factor")).cast("bigint"),
            (F.greatest(F.lit(0), cfg["budget"] - c("wall_cost") - c("walk_extra")) * cfg["per_troop"] * c("loot_factor")).cast("bigint"),
        ),
    })
    gone = c("dist").isNull()
    reason = (
        F.when(gone, "no_landing")
        .when(c("dist") > cfg["max_px"], "too_far")
        .when(c("wall_cost") > cfg["wall_limit"], "walls")
        .when(c("troops_needed") > cfg["budget"], "budget")
        .when(c("risk") > cfg["max_risk"], "risk")
        .when(c("remaining") <= 0, "empty")
        .when(c("expected_loot") < cfg["min_loot"], "not_worth")
        .otherwise("ok")
    )
    t = t.withColumn("reason", reason).withColumn("accessible", c("reason") == "ok")
    zero = {n: F.when(gone, F.lit(0)).otherwise(c(n)) for n in ("wall_cost", "walk_extra", "troops_needed", "expected_loot")}
    t = t.withColumns(zero).withColumns({
        "risk": F.when(gone, 1.0).otherwise(c("risk")), "loot_factor": F.when(gone, 0.0).otherwise(c("loot_factor")),
    })
    efficiency = F.when(c("troops_needed") > 0, c("expected_loot") / (c("troops_needed") * cfg["per_troop"])).otherwise(0.0)
    efficient = c("accessible") & (efficiency >= cfg["min_efficiency"]) & (c("risk") <= cfg["max_risk"] * 0.7)
    return t.withColumn("efficient", efficient).select(
        *kept, "px", "py", F.round("dist", 1).alias("landing_px"), "wall_cost", "walk_extra",
        "troops_needed", F.col("expected_loot").cast("bigint").alias("expected_loot"), F.round("risk", 3).alias("risk"),
        F.round("loot_factor", 3).alias("loot_factor"), "accessible", "reason", "efficient",
    )


def select_target(candidates: DataFrame, limit: int = 2, match_px: int = 48) -> DataFrame:
    """One target per frame: the requested one unless it was hit ``limit`` times in a row, else the best below that limit,
    else the best.

    ``candidates`` are ranked, accessible and not depleted, each with the request of its frame (r_name, rx, ry) and the last
    choice (l_name, lx, ly, repeats); NULL where there is none.
    """
    c = F.col
    near = lambda n, x, y: (c("name") == c(n)) & (
        g.squared_distance(c("x"), c("y"), c(x), c(y)) <= match_px * match_px
    )
    q = candidates.withColumns({
        "asked": F.coalesce(near("r_name", "rx", "ry"), F.lit(False)),
        "tired": F.coalesce(near("l_name", "lx", "ly") & (c("repeats") >= limit), F.lit(False)),
    })
    # the request is the best ranked row in reach of it, and it is honoured only if that row is not tired
    chosen = F.struct("det_no", "name", "x", "y", "px", "py", "score", "troops_needed", "expected_loot", "tired")
    per = q.groupBy("frame_id").agg(
        F.min_by(chosen, F.when(c("asked"), c("rank"))).alias("req"),
        F.min_by(chosen, F.when(~c("tired"), c("rank"))).alias("fresh"),
        F.min_by(chosen, "rank").alias("best"),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    honoured = c("req").isNotNull() & ~c("req.tired")
    pick = F.when(honoured, c("req")).otherwise(F.coalesce("fresh", "best"))
    return per.select("frame_id", pick.alias("p"), honoured.alias("honoured"), "n_candidates").select(
        "frame_id", *[F.col("p")[n].alias(n) for n in ("det_no", "name", "x", "y", "px", "py", "score", "troops_needed", "expected_loot")],
        "honoured", "n_candidates",
    )


# --- actions -----------------------------------------------------------------------------


def validate_actions(actions: DataFrame, size: tuple[int, int], targets=vocab.ACTION_TARGETS, margin: int = 5) -> DataFrame:
    """(kind, target, x, y, troop_x, troop_y) to allowed, reason and risk; the first failure counts."""
    w, h = size
    c = F.col
    inside = lambda x, y: (c(x) >= margin) & (c(x) < w - margin) & (c(y) >= margin) & (c(y) < h - margin)
    placed = c("kind").isin("tap", "deploy")
    reason = (
        F.when(~c("kind").isin(vocab.ACTION_KINDS), "kind")
        .when(placed & (c("x").isNull() | c("y").isNull()), "no_coords")
        .when(placed & ~inside("x", "y"), "out_of_bounds")
        .when((c("kind") == "deploy") & c("troop_x").isNotNull() & ~inside("troop_x", "troop_y"), "troop_out_of_bounds")
        .when(placed & (c("target").isNull() | ~c("target").isin(list(targets))), "target")
        .otherwise("ok")
    )
    base = vocab.lookup(c("kind"), vocab.KIND_RISK, "low")
    risk = F.when(c("reason") == "kind", "high").when(c("reason").isin("no_coords", "ok"), base).otherwise("medium")
    return actions.withColumn("reason", reason).withColumn("allowed", c("reason") == "ok").withColumn("risk", risk)


def structured_errors(action: Column, target: Column, allowed_targets: Column) -> Column:
    """All errors of a structured action; an empty target list switches that check off."""
    missing = action.isNull() | (action == "")
    return F.array_compact(F.array(
        F.when(missing, F.lit("Missing 'action' field")).when(
            ~action.isin(vocab.STRUCTURED_ACTIONS), F.concat(F.lit("Action '"), action, F.lit("' is not in allowed set"))
        ),
        F.when(
            target.isNotNull() & (F.size(allowed_targets) > 0) & ~F.array_contains(allowed_targets, target),
            F.concat(F.lit("Target '"), target, F.lit("' not present in current state")),
        ),
    ))


def risk_level(confidence: Column, confirm: Column, sensitive: Column) -> tuple[Column, Column]:
    """Risk in tenths, as integers, and its level."""
    tenths = F.when(confidence < 0.6, 4).otherwise(0) + F.when(confirm, 3).otherwise(0) + F.when(sensitive, 3).otherwise(0)
    level = (
        F.when(tenths >= 8, "CRITICAL").when(tenths >= 6, "HIGH").when(tenths >= 3, "MEDIUM")
        .when(tenths > 0, "LOW").otherwise("INFO")
    )
    return tenths, level


def donation_feasible(cost: Column, available: Column, buffer: int = vocab.DONATION_BUFFER) -> dict[str, Column]:
    """The gate's view: the buffer must remain."""
    required = F.greatest(F.lit(0), cost) + buffer
    return {
        "required": required, "missing": F.greatest(F.lit(0), required - available), "enough": available >= required,
    }


def donation_supply(required: Column, available: Column, troop_available: Column) -> dict[str, Column]:
    """The state machine's view: no buffer, unread resources count as enough."""
    need = F.greatest(F.lit(0), required)
    enough = F.when(~troop_available, False).when(required <= 0, True).when(available.isNull(), True).otherwise(available >= required)
    missing = F.when(~troop_available, need).when((required <= 0) | available.isNull(), 0).otherwise(
        F.greatest(F.lit(0), required - available)
    )
    return {"enough": enough, "missing": missing}
