"""Queries on neighbours, target scores, loot and action checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.operators import labels as lb
from sightlog.operators import scoring as sc
from sightlog.operators import spatial as sp
from sightlog.plans.registry import query
from sightlog.plans.views import case
from sightlog.sources import tables as src

W, H = src.CANVAS
KEY = ["frame_id"]
D2 = "((t.x-{0}.x)*(t.x-{0}.x)+(t.y-{0}.y)*(t.y-{0}.y))".format

NEAR_DEF = f"""nd AS (SELECT t.frame_id, t.det_no, min(CASE WHEN d.frame_id IS NOT NULL THEN least(sqrt({D2('d')}::DOUBLE), 200) END) AS defence_px
  FROM targets t LEFT JOIN defences d ON d.frame_id = t.frame_id GROUP BY ALL)"""


def guarded(spark, sf):
    """Targets with their neighbours: one scan of the points, one of the targets."""
    return sc.with_neighbours(src.targets(spark, sf), src.frame_points(spark, sf))


@query("jo5_nearest_defence", f"WITH {NEAR_DEF} SELECT frame_id, det_no, defence_px FROM nd", "targets defences")
def nearest_defence(spark, sf):
    return guarded(spark, sf).select("frame_id", "det_no", "defence_px")


NEAR_LAND = f"""nl AS (SELECT t.frame_id, t.det_no, min(ROW({D2('p')}, p.y, p.x)) FILTER ({D2('p')} <= 320*320) AS b
  FROM targets t LEFT JOIN landable p ON p.frame_id = t.frame_id GROUP BY ALL)"""


@query(
    "jo12_nearest_landable_point",
    f"""SELECT t.frame_id, t.det_no, min({D2('p')})::BIGINT AS d2, CAST(arg_min(p.x, ROW({D2('p')}, p.y, p.x)) AS INT) AS px, CAST(arg_min(p.y, ROW({D2('p')}, p.y, p.x)) AS INT) AS py
FROM targets t JOIN landable p ON p.frame_id = t.frame_id AND {D2('p')} <= 320*320 GROUP BY ALL""",
    "targets landable",
)
def nearest_landable_point(spark, sf):
    t = src.targets(spark, sf).select("frame_id", "det_no", "x", "y")
    near = sp.nearest(t, src.landable(spark, sf), KEY, sc.LANDING_PX)
    return t.join(near, KEY + ["x", "y"]).select("frame_id", "det_no", "d2", "px", "py")


@query(
    "jo6_first_match_in_radius",
    f"""SELECT t.frame_id, t.det_no, min(k.det_no) AS match_no FROM targets t JOIN targets k ON k.frame_id = t.frame_id AND k.name = t.name AND {D2('k')} <= 48*48 GROUP BY ALL""",
    "targets",
)
def first_match_in_radius(spark, sf):
    t = src.targets(spark, sf)
    hit = sp.first_in_reach(t, t, ["frame_id", "name"], 48, "det_no", []).withColumnRenamed("det_no", "match_no")
    return t.join(hit, ["frame_id", "name", "x", "y"]).select("frame_id", "det_no", "match_no")


REQ = "req AS (SELECT o_orderkey AS frame_id, {0} AS r_name, CAST(o_custkey * 7 % 1280 AS INT) AS rx, CAST(o_custkey * 11 % 720 AS INT) AS ry FROM orders)".format(
    case("o_orderkey % 7", dict(enumerate(vocab.RESOURCE_CLASSES)))
)


def requests(spark, sf):
    o = src.table(spark, sf, "orders")
    name = vocab.lookup((F.col("o_orderkey") % 7).cast("int"), dict(enumerate(vocab.RESOURCE_CLASSES)))
    return o.select(
        F.col("o_orderkey").alias("frame_id"), name.alias("r_name"),
        F.expr("CAST(o_custkey * 7 % 1280 AS INT)").alias("rx"), F.expr("CAST(o_custkey * 11 % 720 AS INT)").alias("ry"),
    )


@query(
    "jo13_nearest_box_of_name",
    f"""WITH {REQ} SELECT r.frame_id, r.r_name, coalesce(arg_min(t.x, ROW((t.x-rx)*(t.x-rx)+(t.y-ry)*(t.y-ry), t.det_no)), any_value(rx)) AS x,
  coalesce(arg_min(t.y, ROW((t.x-rx)*(t.x-rx)+(t.y-ry)*(t.y-ry), t.det_no)), any_value(ry)) AS y
FROM req r LEFT JOIN targets t ON t.frame_id = r.frame_id AND t.name = r.r_name GROUP BY ALL""",
    "targets",
)
def nearest_box_of_name(spark, sf):
    # one request per frame: boxes are compared with it and folded, no pairs are kept
    r = requests(spark, sf)
    t = src.targets(spark, sf).select("frame_id", "det_no", "name", "x", "y")
    d2 = g.squared_distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    best = (
        t.join(r, [t.frame_id == r.frame_id, t.name == r.r_name]).select(r.frame_id, "x", "y", d2.alias("d2"), "det_no")
        .groupBy("frame_id").agg(F.min(F.struct("d2", "det_no", "x", "y")).alias("b"))
    )
    return r.join(best, "frame_id", "left").select(
        "frame_id", "r_name", F.coalesce("b.x", "rx").alias("x"), F.coalesce("b.y", "ry").alias("y")
    )


@query(
    "jo7_requested_candidates_added",
    f"""WITH {REQ}, miss AS (SELECT * FROM req r WHERE r_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.frame_id = r.frame_id AND t.name = r.r_name AND (t.x-rx)*(t.x-rx)+(t.y-ry)*(t.y-ry) <= 48*48))
SELECT frame_id, name, x, y, 'local' AS origin FROM targets UNION ALL SELECT frame_id, r_name, rx, ry, 'requested' FROM miss""",
    "targets",
)
def requested_candidates_added(spark, sf):
    t = src.targets(spark, sf).select("frame_id", "name", "x", "y")
    r = requests(spark, sf).filter("r_name IS NOT NULL").selectExpr("frame_id", "r_name AS name", "rx AS x", "ry AS y")
    have = sp.within_reach(
        r, t.distinct().withColumnsRenamed({"x": "px", "y": "py"}), ["frame_id", "name"], 48
    ).select("frame_id")
    new = r.join(have, "frame_id", "left_anti")
    return t.withColumn("origin", F.lit("local")).unionByName(new.withColumn("origin", F.lit("requested")))


@query(
    "jo7_teacher_candidates_added",
    f"""WITH {REQ}, x AS (SELECT frame_id, name, x, y FROM targets WHERE det_no % 3 = 0 UNION SELECT frame_id, r_name, rx, ry FROM req WHERE r_name IS NOT NULL)
SELECT frame_id, name, x, y, 'local' AS origin FROM targets UNION ALL SELECT *, 'teacher' FROM x WHERE (frame_id, name, x, y) NOT IN (SELECT (frame_id, name, x, y) FROM targets)""",
    "targets",
)
def teacher_candidates_added(spark, sf):
    t = src.targets(spark, sf).select("frame_id", "det_no", "name", "x", "y")
    r = requests(spark, sf).filter("r_name IS NOT NULL").selectExpr("frame_id", "r_name AS name", "rx AS x", "ry AS y")
    key = ["frame_id", "name", "x", "y"]
    given = t.filter("det_no % 3 = 0").select(*key).unionByName(r).distinct()
    new = given.join(t, key, "left_anti")
    return t.select(*key).withColumn("origin", F.lit("local")).unionByName(new.withColumn("origin", F.lit("teacher")))


ORI = lambda p, q, r: f"(({q}x-{p}x)*({r}y-{p}y)-({q}y-{p}y)*({r}x-{p}x))"
ON = lambda p, q, r: f"(least({p}x,{q}x)<={r}x AND {r}x<=greatest({p}x,{q}x) AND least({p}y,{q}y)<={r}y AND {r}y<=greatest({p}y,{q}y))"
MEET = f"""(NOT (greatest(ex,fx)<least(gx,hx) OR greatest(gx,hx)<least(ex,fx) OR greatest(ey,fy)<least(gy,hy) OR greatest(gy,hy)<least(ey,fy)) AND (
 ({ORI('g','h','e')}=0 AND {ON('g','h','e')}) OR ({ORI('g','h','f')}=0 AND {ON('g','h','f')}) OR ({ORI('e','f','g')}=0 AND {ON('e','f','g')}) OR ({ORI('e','f','h')}=0 AND {ON('e','f','h')})
 OR ((({ORI('g','h','e')}>0) <> ({ORI('g','h','f')}>0)) AND (({ORI('e','f','g')}>0) <> ({ORI('e','f','h')}>0)))))"""
LANDED = f"""land AS (SELECT t.frame_id, t.det_no, any_value(t.x) AS x, any_value(t.y) AS y, min({D2('p')}) AS d2, arg_min(p.x, ROW({D2('p')}, p.y, p.x)) AS px, arg_min(p.y, ROW({D2('p')}, p.y, p.x)) AS py
  FROM targets t JOIN landable p ON p.frame_id = t.frame_id AND {D2('p')} <= 320*320 GROUP BY t.frame_id, t.det_no),
lw AS (SELECT frame_id, det_no, count(*) FILTER (WHERE {MEET}) AS layers FROM (SELECT l.frame_id, l.det_no, l.px AS ex, l.py AS ey, l.x AS fx, l.y AS fy, w.x1 AS gx, w.y1 AS gy, w.x2 AS hx, w.y2 AS hy
  FROM land l JOIN walls w ON w.frame_id = l.frame_id) GROUP BY ALL)"""


@query(
    "jo11_walls_crossed",
    f"WITH {LANDED} SELECT l.frame_id, l.det_no, CAST(3 * least(2, coalesce(layers, 0)) AS INT) AS wall_cost FROM land l LEFT JOIN lw USING (frame_id, det_no)",
    "targets landable walls",
)
def walls_crossed(spark, sf):
    t = src.targets(spark, sf).select("frame_id", "det_no", "x", "y")
    route = sp.nearest(t, src.landable(spark, sf), KEY, sc.LANDING_PX)
    layers = sp.crossing_layers(route, src.walls(spark, sf), KEY)
    j = t.join(route, KEY + ["x", "y"]).join(layers, KEY + ["x", "y", "px", "py"], "left")
    return j.select("frame_id", "det_no", (F.coalesce("layers", F.lit(0)) * 3).cast("int").alias("wall_cost"))


# --- scores --------------------------------------------------------------------------------------

FULL = "full_res AS (SELECT frame_id, r AS resource FROM (SELECT o_orderkey AS frame_id, CASE o_orderkey % 4 WHEN 0 THEN ['gold'] WHEN 1 THEN ['elixir', 'dark'] ELSE [] END AS rs FROM orders), unnest(rs) u(r))"
RES = case("name", vocab.BUILDING_RESOURCE)
VALUE = case("name", vocab.BASE_VALUE)


def full_resources(spark, sf):
    o = src.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS frame_id",
        "explode(CASE o_orderkey % 4 WHEN 0 THEN array('gold') WHEN 1 THEN array('elixir', 'dark') ELSE array() END) AS resource",
    )
    return o


def score_sql(land: bool) -> str:
    edge = "1 - least(1, least(x, y, 1280 - x, 720 - y) / 360)"
    acc = f"CASE WHEN has_land THEN CASE WHEN l2 IS NULL THEN 0 ELSE least(1, greatest(0, 1 - sqrt(l2::DOUBLE) / 120)) END ELSE {edge} END" if land else edge
    return f"""open_t AS (SELECT t.* FROM targets t WHERE NOT EXISTS (SELECT 1 FROM full_res f WHERE f.frame_id = t.frame_id AND f.resource = {RES})),
al AS (SELECT t.frame_id, t.det_no, min({D2('p')}) AS l2 FROM targets t JOIN landable p ON p.frame_id = t.frame_id AND {D2('p')} <= 14400 GROUP BY ALL),
sc AS (SELECT *, round(0.4::DOUBLE * value + 0.35::DOUBLE * access + 0.15::DOUBLE * safety + 0.1::DOUBLE * distance, 6) AS score FROM (
  SELECT t.frame_id, t.det_no, t.name, t.x, t.y, {VALUE} AS value, CAST({acc} AS DOUBLE) AS access, CASE WHEN defence_px IS NULL THEN 0.5 ELSE least(1, defence_px / 200) END AS safety,
  least(1, greatest(0, (sqrt(2156800::DOUBLE) - sqrt(((x-640)*(x-640)+(y-710)*(y-710))::DOUBLE)) / sqrt(2156800::DOUBLE))) AS distance
  FROM open_t t LEFT JOIN nd USING (frame_id, det_no) LEFT JOIN al USING (frame_id, det_no) LEFT JOIN (SELECT DISTINCT frame_id, true AS has_land FROM landable) h USING (frame_id))),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_no) AS rank FROM sc)"""


SC_VIEWS = "targets defences landable walls"
SCORED = f"WITH {FULL}, {NEAR_DEF}, {score_sql(True)}"
SCORE_OUT = "frame_id, det_no, value, round(access, 6) AS access, round(safety, 6) AS safety, round(distance, 6) AS distance, round(score, 6) AS score"


def scored(spark, sf, land=True):
    t = sc.skip_full(guarded(spark, sf), full_resources(spark, sf))
    return sc.score_targets(t if land else t.drop("landable", "has_landable"), (W, H))


def score_out(df):
    return df.select(
        "frame_id", "det_no", "value", *[F.round(n, 6).alias(n) for n in ("access", "safety", "distance")], "score"
    )


@query("so1_target_score", f"{SCORED} SELECT {SCORE_OUT} FROM sc", SC_VIEWS)
def target_score(spark, sf):
    return score_out(scored(spark, sf))


@query("so1_target_score_edge", f"WITH {FULL}, {NEAR_DEF}, {score_sql(False)} SELECT {SCORE_OUT} FROM sc", SC_VIEWS)
def target_score_edge(spark, sf):
    return score_out(scored(spark, sf, land=False))


@query(
    "fi2_full_resource_skip",
    f"WITH {FULL} SELECT name, CAST(count(*) AS BIGINT) AS n FROM targets t WHERE NOT EXISTS (SELECT 1 FROM full_res f WHERE f.frame_id = t.frame_id AND f.resource = {RES}) GROUP BY name",
    "targets",
)
def full_resource_skip(spark, sf):
    t = sc.skip_full(src.targets(spark, sf), full_resources(spark, sf))
    return t.groupBy("name").agg(lb.count_rows("n"))


@query("tk1_top_targets", f"{SCORED} SELECT frame_id, det_no, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 3", SC_VIEWS)
def top_targets(spark, sf):
    return sc.rank_targets(scored(spark, sf), 3).select("frame_id", "det_no", "rank")


@query("ud1_policy_as_transform", f"{SCORED} SELECT frame_id, det_no FROM rk WHERE rank = 1", SC_VIEWS)
def policy_as_transform(spark, sf):
    """A policy is any function from targets to ordered targets, applied with ``transform``."""
    best_only = lambda df: sc.rank_targets(sc.score_targets(df, (W, H)), 1)
    t = sc.skip_full(guarded(spark, sf), full_resources(spark, sf))
    return t.transform(best_only).select("frame_id", "det_no")


@query(
    "ag22_plan_summary",
    f"""{SCORED}, d AS (SELECT DISTINCT frame_id, true AS used FROM defences)
SELECT f.frame_id, list(rk.name ORDER BY rank) FILTER (rank <= 3) AS top_names, CAST(count(rk.det_no) AS BIGINT) AS n_candidates,
  (SELECT list_sort(list(n)) FROM (VALUES {', '.join(f"('{n}', '{r}')" for n, r in vocab.BUILDING_RESOURCE.items())}) v(n, r) WHERE r IN (SELECT resource FROM full_res fr WHERE fr.frame_id = f.frame_id)) AS skipped,
  coalesce(any_value(d.used), false) AS defences_used
FROM (SELECT o_orderkey AS frame_id FROM orders) f LEFT JOIN rk USING (frame_id) LEFT JOIN d ON d.frame_id = f.frame_id GROUP BY f.frame_id""",
    SC_VIEWS,
)
def plan_summary(spark, sf):
    ranked = sc.rank_targets(scored(spark, sf))
    # the list holds the k best only, as the plan does
    top = ranked.groupBy("frame_id").agg(
        *[F.max(F.when(F.col("rank") == k, F.col("name"))).alias(f"n{k}") for k in (1, 2, 3)], lb.count_rows("n_candidates")
    )
    buildings = spark.createDataFrame(list(vocab.BUILDING_RESOURCE.items()), "building STRING, resource STRING")
    skipped = full_resources(spark, sf).join(F.broadcast(buildings), "resource").groupBy("frame_id").agg(
        F.array_sort(F.collect_set("building")).alias("skipped")
    )
    used = src.defences(spark, sf).select("frame_id").distinct().withColumn("defences_used", F.lit(True))
    f = src.frames(spark, sf).select("frame_id").join(top, "frame_id", "left").join(skipped, "frame_id", "left").join(used, "frame_id", "left")
    names = F.array_compact(F.array("n1", "n2", "n3"))
    return f.select(
        "frame_id", F.when(F.size(names) > 0, names).alias("top_names"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        "skipped", F.coalesce("defences_used", F.lit(False)).alias("defences_used"),
    )


# --- loot ----------------------------------------------------------------------------------------------

CAP = case("name", vocab.CAPACITY)
LOOT = f"""{NEAR_DEF}, {LANDED},
kn AS (SELECT frame_id, det_no, name, x, y, CASE WHEN det_no % 5 = 0 THEN 900 + CAST(det_no % 3000 AS INT) END AS capacity, CASE WHEN det_no % 7 = 0 THEN CAST(det_no % 2500 AS INT) END AS looted FROM targets),
km AS (SELECT t.frame_id, t.det_no, arg_min(ROW(k.capacity, k.looted), k.det_no) AS v FROM targets t JOIN kn k ON k.frame_id = t.frame_id AND k.name = t.name AND {D2('k')} <= 576 GROUP BY ALL),
a AS (SELECT t.frame_id, t.det_no, t.name, t.x, t.y, px, py, sqrt(d2::DOUBLE) AS dist, greatest(0, coalesce(v[1], CASE WHEN t.det_no % 3 = 0 THEN CAST(trunc({CAP} * (0.8::DOUBLE + 0.15::DOUBLE * greatest(1, t.det_no % 12))) AS INT) ELSE {CAP} END) - coalesce(v[2], 0)) AS remaining,
  3 * least(2, coalesce(layers, 0)) AS wall, CASE WHEN defence_px IS NULL THEN 0.1::DOUBLE ELSE least(1, greatest(0, 1 - defence_px / 200)) END AS risk
  FROM targets t LEFT JOIN nd USING (frame_id, det_no) LEFT JOIN (SELECT frame_id, det_no, px, py, d2 FROM land) USING (frame_id, det_no) LEFT JOIN lw USING (frame_id, det_no) LEFT JOIN km USING (frame_id, det_no)),
b AS (SELECT *, CASE WHEN dist > 120 THEN CAST(ceil((dist - 120) / 180) AS INT) ELSE 0 END AS walk, CASE WHEN dist > 120 THEN greatest(0.35::DOUBLE, 1 - least(1, (dist - 120) / 140) * 0.8::DOUBLE) ELSE 1.0::DOUBLE END AS factor,
  CAST(ceil(remaining / 1000) AS INT) AS base FROM a),
c AS (SELECT *, base + wall + walk AS needed, least(remaining, trunc(base * 1000 * factor), trunc(greatest(0, 30 - wall - walk) * 1000 * factor)) AS expected FROM b),
e AS (SELECT *, CASE WHEN dist IS NULL THEN 'no_landing' WHEN dist > 260 THEN 'too_far' WHEN wall > 6 THEN 'walls' WHEN needed > 30 THEN 'budget' WHEN risk > 0.8 THEN 'risk'
  WHEN remaining <= 0 THEN 'empty' WHEN expected < 400 THEN 'not_worth' ELSE 'ok' END AS reason FROM c),
est AS (SELECT frame_id, det_no, name, x, y, CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(dist, 1) AS landing_px, CAST(CASE WHEN dist IS NULL THEN 0 ELSE wall END AS INT) AS wall_cost,
  CASE WHEN dist IS NULL THEN 0 ELSE walk END AS walk_extra, CAST(CASE WHEN dist IS NULL THEN 0 ELSE needed END AS INT) AS troops_needed, CAST(CASE WHEN dist IS NULL THEN 0 ELSE expected END AS BIGINT) AS expected_loot,
  CASE WHEN dist IS NULL THEN 1.0 ELSE round(risk, 3) END AS risk, CASE WHEN dist IS NULL THEN 0.0 ELSE round(factor, 3) END AS loot_factor, reason = 'ok' AS accessible, reason,
  reason = 'ok' AND expected / (needed * 1000) >= 0.35 AND risk <= 0.8::DOUBLE * 0.7::DOUBLE AS efficient FROM e)"""


def estimates(spark, sf, base):
    t = base.withColumn("level", F.when(F.col("det_no") % 3 == 0, F.col("det_no") % 12))
    known = src.targets(spark, sf).select(
        "frame_id", "det_no", "name", "x", "y",
        F.expr("CASE WHEN det_no % 5 = 0 THEN 900 + CAST(det_no % 3000 AS INT) END").alias("capacity"),
        F.expr("CASE WHEN det_no % 7 = 0 THEN CAST(det_no % 2500 AS INT) END").alias("looted"),
    )
    return sc.estimate_loot(t, src.walls(spark, sf), known)


@query("so2_loot_estimate", f"WITH {LOOT} SELECT * FROM est", SC_VIEWS)
def loot_estimate(spark, sf):
    return estimates(spark, sf, guarded(spark, sf)).select(
        "frame_id", "det_no", "name", "x", "y", "px", "py", "landing_px", "wall_cost", "walk_extra", "troops_needed", "expected_loot", "risk", "loot_factor",
        "accessible", "reason", "efficient",
    )


PICK = f"""WITH {FULL}, {LOOT}, {score_sql(True)}, {REQ},
lst AS (SELECT o_orderkey AS frame_id, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT name FROM rk WHERE rk.frame_id = o_orderkey AND rank = 1) END AS l_name,
  (SELECT x FROM rk WHERE rk.frame_id = o_orderkey AND rank = 1) AS lx, (SELECT y FROM rk WHERE rk.frame_id = o_orderkey AND rank = 1) AS ly, CAST(o_orderkey % 3 + 1 AS INT) AS repeats FROM orders),
q AS (SELECT rk.*, est.px, est.py, troops_needed, expected_loot, coalesce(rk.name = r_name AND (rk.x-rx)*(rk.x-rx)+(rk.y-ry)*(rk.y-ry) <= 2304, false) AS asked,
  coalesce(rk.name = l_name AND (rk.x-lx)*(rk.x-lx)+(rk.y-ly)*(rk.y-ly) <= 2304 AND repeats >= 2, false) AS tired
  FROM rk JOIN est ON est.frame_id = rk.frame_id AND est.det_no = rk.det_no AND est.accessible LEFT JOIN req ON req.frame_id = rk.frame_id LEFT JOIN lst ON lst.frame_id = rk.frame_id WHERE rk.det_no % 13 <> 0),
p AS (SELECT frame_id, arg_min(det_no, rank) FILTER (asked) AS req_no, arg_min(tired, rank) FILTER (asked) AS req_tired, arg_min(det_no, rank) FILTER (NOT tired) AS fresh, arg_min(det_no, rank) AS best, count(*) AS n FROM q GROUP BY 1),
s AS (SELECT frame_id, req_no IS NOT NULL AND NOT req_tired AS honoured, CASE WHEN req_no IS NOT NULL AND NOT req_tired THEN req_no ELSE coalesce(fresh, best) END AS det_no, CAST(n AS BIGINT) AS n_candidates FROM p)"""


def selection(spark, sf):
    open_targets = sc.skip_full(guarded(spark, sf), full_resources(spark, sf))
    ranked = sc.rank_targets(sc.score_targets(open_targets, (W, H)))
    # the last choice of a frame is taken to be its best target, so it comes from the window that ranks
    by_rank = Window.partitionBy("frame_id").orderBy(F.desc("score"), "det_no")
    best = F.first(F.struct("name", "x", "y")).over(by_rank)
    even = F.col("frame_id") % 2 == 0
    ranked = ranked.withColumn("_best", best).withColumns({
        "l_name": F.when(even, F.col("_best.name")), "lx": F.col("_best.x"), "ly": F.col("_best.y"), "repeats": (F.col("frame_id") % 3 + 1).cast("int"),
    }).drop("_best")
    able = estimates(spark, sf, ranked).filter("accessible AND det_no % 13 <> 0")
    return sc.select_target(able.join(requests(spark, sf), "frame_id", "left"))


@query(
    "so10_deploy_selection",
    f"{PICK} SELECT frame_id, det_no, honoured, n_candidates FROM s",
    SC_VIEWS,
)
def deploy_selection(spark, sf):
    return selection(spark, sf).select("frame_id", "det_no", "honoured", "n_candidates")


@query(
    "pr25_plan_action_rows",
    f"{PICK} SELECT s.frame_id, 'deploy' AS kind, q.name AS target, q.px AS x, q.py AS y, q.score AS target_score, q.troops_needed, q.expected_loot FROM s JOIN q USING (frame_id, det_no)",
    SC_VIEWS,
)
def plan_action_rows(spark, sf):
    return selection(spark, sf).select(
        "frame_id", F.lit("deploy").alias("kind"), F.col("name").alias("target"), F.col("px").alias("x"), F.col("py").alias("y"),
        F.col("score").alias("target_score"), "troops_needed", "expected_loot",
    )


@query(
    "ud2_providers_as_inputs",
    f"WITH {NEAR_DEF} SELECT CASE WHEN defence_px IS NULL THEN 'none' WHEN defence_px < 200 THEN 'near' ELSE 'far' END AS cover, CAST(count(*) AS BIGINT) AS n FROM nd GROUP BY 1",
    "targets defences",
)
def providers_as_inputs(spark, sf):
    """Providers of defences or landing places are further input tables joined by frame."""
    cover = F.when(F.col("defence_px").isNull(), "none").when(F.col("defence_px") < 200, "near").otherwise("far")
    return guarded(spark, sf).groupBy(cover.alias("cover")).agg(lb.count_rows("n"))


# --- objectives, donations, risk --------------------------------------------------------------------------


@query(
    "fi3_objective_match",
    f"""WITH o AS (SELECT frame_id, det_no, name, CASE frame_id % 3 WHEN 0 THEN ['gold'] WHEN 1 THEN ['elixir', 'dark_elixir'] ELSE ['dark'] END AS types FROM targets)
SELECT frame_id, det_no FROM o WHERE list_contains(types, {RES}) OR ({RES} = 'dark' AND list_contains(types, 'dark_elixir'))""",
    "targets",
)
def objective_match(spark, sf):
    t = src.targets(spark, sf)
    types = F.expr("CASE frame_id % 3 WHEN 0 THEN array('gold') WHEN 1 THEN array('elixir', 'dark_elixir') ELSE array('dark') END")
    t = t.withColumn("types", types).withColumn("r", vocab.lookup(F.col("name"), vocab.BUILDING_RESOURCE))
    hit = F.array_contains("types", F.col("r")) | ((F.col("r") == "dark") & F.array_contains("types", "dark_elixir"))
    return t.filter(hit).select("frame_id", "det_no")


AMOUNT = "amt AS (SELECT o_orderkey AS frame_id, CAST(o_totalprice AS BIGINT) AS gold, CAST(o_totalprice / 2 AS BIGINT) AS elixir, CAST(o_totalprice / 40 AS BIGINT) AS dark_elixir, o_custkey FROM orders)"


def amounts(spark, sf):
    # rounding before the cast keeps both engines on the same integer
    return src.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS frame_id", "CAST(round(o_totalprice) AS BIGINT) AS gold", "CAST(round(o_totalprice / 2) AS BIGINT) AS elixir",
        "CAST(round(o_totalprice / 40) AS BIGINT) AS dark_elixir", "o_custkey",
    )


AMOUNT = AMOUNT.replace("CAST(o_totalprice AS", "CAST(round(o_totalprice) AS").replace("CAST(o_totalprice / 2 AS", "CAST(round(o_totalprice / 2) AS").replace("CAST(o_totalprice / 40 AS", "CAST(round(o_totalprice / 40) AS")


@query(
    "fi4_objective_met",
    f"""WITH {AMOUNT} SELECT frame_id, CASE frame_id % 3 WHEN 0 THEN false WHEN 1 THEN gold >= 150000 ELSE gold >= 100000 AND dark_elixir >= 5000 END AS met FROM amt""",
)
def objective_met(spark, sf):
    a = amounts(spark, sf).withColumn(
        "need",
        F.expr("CASE frame_id % 3 WHEN 0 THEN map() WHEN 1 THEN map('gold', 150000L) ELSE map('gold', 100000L, 'dark_elixir', 5000L) END"),
    )
    have = F.create_map(*[x for n in ("gold", "elixir", "dark_elixir") for x in (F.lit(n), F.col(n))])
    entries = F.map_entries("need")
    met = (F.size("need") > 0) & F.forall(entries, lambda e: F.coalesce(F.try_element_at(have, e["key"]), F.lit(0)) >= e["value"])
    return a.select("frame_id", met.alias("met"))


@query(
    "so4_donation_feasibility",
    f"""WITH {AMOUNT}, d AS (SELECT frame_id, CAST(o_custkey * 100 - 20000 AS BIGINT) AS cost, CASE WHEN frame_id % 5 = 0 THEN NULL ELSE elixir END AS have, frame_id % 7 <> 0 AS troop FROM amt)
SELECT frame_id, coalesce(have, 0) >= greatest(0, cost) + 10000 AS gate_enough, greatest(0, greatest(0, cost) + 10000 - coalesce(have, 0)) AS gate_missing,
  CASE WHEN NOT troop THEN false WHEN cost <= 0 OR have IS NULL THEN true ELSE have >= cost END AS machine_enough,
  CAST(CASE WHEN NOT troop THEN greatest(0, cost) WHEN cost <= 0 OR have IS NULL THEN 0 ELSE greatest(0, cost - have) END AS BIGINT) AS machine_missing FROM d""",
)
def donation_feasibility(spark, sf):
    d = amounts(spark, sf).selectExpr(
        "frame_id", "o_custkey * 100 - 20000 AS cost", "CASE WHEN frame_id % 5 = 0 THEN NULL ELSE elixir END AS have",
        "frame_id % 7 <> 0 AS troop",
    )
    gate = sc.donation_feasible(F.col("cost"), F.coalesce("have", F.lit(0)))
    machine = sc.donation_supply(F.col("cost"), F.col("have"), F.col("troop"))
    return d.select(
        "frame_id", gate["enough"].alias("gate_enough"), gate["missing"].alias("gate_missing"),
        machine["enough"].alias("machine_enough"), machine["missing"].alias("machine_missing"),
    )


@query(
    "so3_action_risk",
    """WITH t AS (SELECT frame_id, det_no, CASE WHEN confidence < 0.6 THEN 4 ELSE 0 END + CASE WHEN class_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN class_id % 3 = 0 THEN 3 ELSE 0 END AS tenths FROM det)
SELECT frame_id, det_no, tenths, CASE WHEN tenths >= 8 THEN 'CRITICAL' WHEN tenths >= 6 THEN 'HIGH' WHEN tenths >= 3 THEN 'MEDIUM' WHEN tenths > 0 THEN 'LOW' ELSE 'INFO' END AS level FROM t""",
    "det",
)
def action_risk(spark, sf):
    d = src.detections(spark, sf)
    tenths, level = sc.risk_level(F.col("confidence"), F.col("class_id") % 2 == 0, F.col("class_id") % 3 == 0)
    return d.select("frame_id", "det_no", tenths.alias("tenths"), level.alias("level"))


@query(
    "fi5_action_validation",
    f"""WITH a AS (SELECT *, {case('listed_id', {**{i: n for i, n in enumerate(vocab.CLASSES)}, 4: 'chest'})} AS target FROM actions),
i AS (SELECT *, kind IN ('tap', 'deploy') AS placed, x >= 5 AND x < 1275 AND y >= 5 AND y < 715 AS inside, troop_x >= 5 AND troop_x < 1275 AND troop_y >= 5 AND troop_y < 715 AS troop_inside FROM a),
r AS (SELECT *, CASE WHEN kind NOT IN ('tap', 'deploy', 'wait', 'stop') THEN 'kind' WHEN placed AND x IS NULL THEN 'no_coords' WHEN placed AND NOT inside THEN 'out_of_bounds'
  WHEN kind = 'deploy' AND NOT troop_inside THEN 'troop_out_of_bounds' WHEN placed AND (target IS NULL OR target = 'chest') THEN 'target' ELSE 'ok' END AS reason FROM i)
SELECT frame_id, det_no, kind, reason, reason = 'ok' AS allowed, CASE WHEN reason = 'kind' THEN 'high' WHEN reason IN ('no_coords', 'ok') THEN CASE kind WHEN 'deploy' THEN 'medium' ELSE 'low' END ELSE 'medium' END AS risk FROM r""",
    "actions",
)
def action_validation(spark, sf):
    names = {**dict(enumerate(vocab.CLASSES)), 4: "chest"}
    a = src.actions(spark, sf).withColumn("target", vocab.lookup(F.col("listed_id"), names))
    return sc.validate_actions(a, (W, H)).select("frame_id", "det_no", "kind", "reason", "allowed", "risk")


STRUCT = """CASE class_id % 6 WHEN 0 THEN 'observe' WHEN 1 THEN 'donate_troops' WHEN 2 THEN 'upgrade_building' WHEN 3 THEN 'fly' WHEN 4 THEN '' END"""


@query(
    "fi6_structured_action_errors",
    f"""WITH a AS (SELECT frame_id, det_no, {STRUCT} AS action, CASE WHEN det_no % 2 = 0 THEN type END AS target, CASE WHEN det_no % 3 > 0 THEN ['金矿', '圣水瓶', '关闭按钮'] ELSE [] END AS ok FROM named)
SELECT frame_id, det_no, list_filter([CASE WHEN action IS NULL OR action = '' THEN 'Missing ''action'' field' WHEN action = 'fly' THEN 'Action ''fly'' is not in allowed set' END,
  CASE WHEN target IS NOT NULL AND len(ok) > 0 AND NOT list_contains(ok, target) THEN concat('Target ''', target, ''' not present in current state') END], lambda x: x IS NOT NULL) AS errors FROM a""",
    "named",
)
def structured_action_errors(spark, sf):
    a = src.named_detections(spark, sf).select(
        "frame_id", "det_no", F.expr(STRUCT).alias("action"), F.expr("CASE WHEN det_no % 2 = 0 THEN type END").alias("target"),
        F.expr("CASE WHEN det_no % 3 > 0 THEN array('金矿', '圣水瓶', '关闭按钮') ELSE array() END").alias("ok"),
    )
    return a.select("frame_id", "det_no", sc.structured_errors(F.col("action"), F.col("target"), F.col("ok")).alias("errors"))


@query(
    "fi7_role_permissions",
    f"""WITH a AS (SELECT frame_id, det_no, {STRUCT} AS action, CASE WHEN source = 'ocr' THEN 'admin' WHEN source = 'llm' THEN 'viewer' ELSE 'player' END AS role FROM det),
p AS (SELECT * FROM (VALUES ('admin', '*'), ('viewer', 'observe'), ('player', 'observe'), ('player', 'donate_troops')) v(role, allowed))
SELECT role, action, EXISTS (SELECT 1 FROM p WHERE p.role = a.role AND (p.allowed = '*' OR p.allowed = a.action)) AS permitted, coalesce(action IN ('donate_troops', 'upgrade_building'), false) AS confirm, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL""",
    "det",
)
def role_permissions(spark, sf):
    role = F.expr("CASE WHEN source = 'ocr' THEN 'admin' WHEN source = 'llm' THEN 'viewer' ELSE 'player' END")
    a = src.detections(spark, sf).groupBy(role.alias("role"), F.expr(STRUCT).alias("action")).agg(lb.count_rows("n"))
    grants = spark.createDataFrame(
        [("admin", "*"), ("viewer", "observe"), ("player", "observe"), ("player", "donate_troops")], "role STRING, allowed STRING"
    )
    p = grants.groupBy("role").agg(F.collect_set("allowed").alias("granted"))
    j = a.join(F.broadcast(p), "role", "left")
    permitted = F.array_contains("granted", "*") | F.coalesce(F.array_contains("granted", F.col("action")), F.lit(False))
    return j.select(
        "role", "action", F.coalesce(permitted, F.lit(False)).alias("permitted"),
        F.coalesce(F.col("action").isin(vocab.CONFIRM_ACTIONS), F.lit(False)).alias("confirm"), "n",
    )


@query(
    "pr16_state_candidates",
    f"""WITH a AS (SELECT DISTINCT frame_id, lower(trim(item)) AS item FROM (SELECT o_orderkey AS frame_id, unnest(CASE o_orderkey % 4 WHEN 0 THEN [' Gold ', 'rubies'] WHEN 1 THEN ['圣水', 'DARK_ELIXIR'] ELSE [] END) AS item FROM orders)),
f AS (SELECT DISTINCT frame_id, {case('item', vocab.RESOURCE_ALIASES)} AS resource FROM a), p AS (SELECT *, CASE WHEN det_no % 19 = 0 THEN 0 ELSE x END AS px, CASE WHEN det_no % 19 = 0 THEN 0 ELSE y END AS py FROM targets)
SELECT p.frame_id, p.name, CAST(count(*) AS BIGINT) AS n, coalesce(bool_or(f.resource IS NOT NULL), false) AS own_full FROM p LEFT JOIN f ON f.frame_id = p.frame_id AND f.resource = {RES} WHERE NOT (px = 0 AND py = 0) GROUP BY ALL""",
    "targets",
)
def state_candidates(spark, sf):
    said = src.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS frame_id",
        "explode(CASE o_orderkey % 4 WHEN 0 THEN array(' Gold ', 'rubies') WHEN 1 THEN array('圣水', 'DARK_ELIXIR') ELSE array() END) AS item",
    )
    full = said.withColumn("resource", vocab.lookup(F.lower(F.trim("item")), vocab.RESOURCE_ALIASES)).filter(
        "resource IS NOT NULL"
    ).select("frame_id", "resource", F.lit(True).alias("is_full")).distinct()
    t = src.targets(spark, sf).filter("NOT (det_no % 19 = 0 OR (x = 0 AND y = 0))").withColumn(
        "resource", vocab.lookup(F.col("name"), vocab.BUILDING_RESOURCE)
    )
    per = t.groupBy("frame_id", "name", "resource").agg(lb.count_rows("n"))
    return per.join(full, ["frame_id", "resource"], "left").select(
        "frame_id", "name", "n", F.coalesce("is_full", F.lit(False)).alias("own_full")
    )


@query(
    "so9_worth_evaluation",
    f"""WITH {FULL}, t AS (SELECT t.frame_id, count(*) FILTER (f.resource IS NULL) AS n_open FROM targets t LEFT JOIN full_res f ON f.frame_id = t.frame_id AND f.resource = {RES} GROUP BY 1)
SELECT o_orderkey AS frame_id, n_open > 0 AS worth FROM orders LEFT JOIN t ON t.frame_id = o_orderkey""",
    "targets",
)
def worth_evaluation(spark, sf):
    full = full_resources(spark, sf).withColumn("is_full", F.lit(True))
    t = src.targets(spark, sf).withColumn("resource", vocab.lookup(F.col("name"), vocab.BUILDING_RESOURCE))
    per = t.groupBy("frame_id", "resource").agg(lb.count_rows("n")).join(full, ["frame_id", "resource"], "left")
    open_ = per.groupBy("frame_id").agg(F.count_if(F.col("is_full").isNull()).alias("n_open"))
    return src.frames(spark, sf).select("frame_id").join(open_, "frame_id", "left").select("frame_id", (F.col("n_open") > 0).alias("worth"))


@query(
    "fn12_distance",
    "SELECT frame_id, det_no, sqrt(((x-640)*(x-640)+(y-360)*(y-360))::DOUBLE) AS dist FROM targets",
    "targets",
)
def distance(spark, sf):
    t = src.targets(spark, sf)
    return t.select("frame_id", "det_no", g.distance(F.col("x"), F.col("y"), F.lit(W // 2), F.lit(H // 2)).alias("dist"))
