"""Queries on ordered session logs: gates, streaks, replays, memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.operators import labels as lb
from sightlog.operators import machines as ma
from sightlog.operators import replay as rp
from sightlog.operators import rotation as rt
from sightlog.operators import sites as st
from sightlog.operators.segments import global_rank, ordered
from sightlog.plans import scoring_queries as sq
from sightlog.plans.registry import query
from sightlog.plans.views import VIEWS, case
from sightlog.sources import tables as src

W, H = src.CANVAS
SESSION, ORDER = ["session_id"], ["event_id"]
OVER = "OVER (PARTITION BY session_id ORDER BY event_id)"

GATE = f"""g AS (SELECT session_id, event_id, amount, coalesce(last_value(CASE WHEN amount >= 100 THEN false WHEN amount <= 20 THEN true END IGNORE NULLS) {OVER}, false) AS flagged FROM steps)"""


@query(
    "wi1_hysteresis_gate",
    f"WITH {GATE} SELECT session_id, event_id, flagged, CASE WHEN flagged THEN round(greatest(0, 100 - amount), 2) ELSE 0 END AS missing FROM g",
    "steps",
)
def hysteresis_gate(spark, sf):
    s = src.steps(spark, sf).select("session_id", "event_id", "amount")
    g = rp.hysteresis(s, SESSION, ORDER, F.col("amount"), 20, 100, "flagged")
    missing = F.when(F.col("flagged"), F.round(F.greatest(F.lit(0.0), 100 - F.col("amount")), 2)).otherwise(0.0)
    return g.select("session_id", "event_id", "flagged", missing.alias("missing"))


STREAK = """i AS (SELECT session_id, event_id, {hit} AS hit, sum(CASE WHEN {reset} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_id) AS island FROM steps),
k AS (SELECT session_id, event_id, hit, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY event_id) AS BIGINT) AS streak FROM i)"""


@query(
    "wi2_empty_streak",
    f"WITH {STREAK.format(hit='end_b', reset='NOT end_b')} SELECT session_id, event_id, streak, hit AND streak >= 3 AS passes FROM k",
    "steps",
)
def empty_streak(spark, sf):
    s = src.steps(spark, sf).select("session_id", "event_id", "end_b")
    k = rp.streak(s, SESSION, ORDER, F.col("end_b"), ~F.col("end_b"), "streak")
    return k.select("session_id", "event_id", "streak", (F.col("end_b") & (F.col("streak") >= 3)).alias("passes"))


DEPLOY, ENDTAP, HAS = "event_type = 'purchase' AND amount >= 100", "(end_b OR return_b)", "amount < 60"


@query(
    "wi13_end_action_guard",
    f"""WITH {STREAK.format(hit=f'{ENDTAP} AND NOT ({HAS})', reset=f'({DEPLOY}) OR ({ENDTAP} AND {HAS})')}
SELECT session_id, event_id, streak, CASE WHEN {DEPLOY} THEN 'deploy' WHEN {ENDTAP} AND {HAS} THEN 'deploy' WHEN {ENDTAP} AND streak < 3 THEN 'wait' WHEN {ENDTAP} THEN 'end' ELSE 'keep' END AS action
FROM k JOIN steps USING (session_id, event_id)""",
    "steps",
)
def end_action_guard(spark, sf):
    s = src.steps(spark, sf).selectExpr(
        "session_id", "event_id", f"{DEPLOY} AS deploy", f"{ENDTAP} AS end_tap", f"{HAS} AS has_targets"
    )
    saved = F.col("end_tap") & F.col("has_targets")
    k = rp.streak(s, SESSION, ORDER, F.col("end_tap") & ~F.col("has_targets"), F.col("deploy") | saved, "streak")
    action = (
        F.when(F.col("deploy") | saved, "deploy").when(F.col("end_tap") & (F.col("streak") < 3), "wait")
        .when(F.col("end_tap"), "end").otherwise("keep")
    )
    return k.select("session_id", "event_id", "streak", action.alias("action"))


@query(
    "wi3_same_target_run",
    """WITH p AS (SELECT session_id, event_id, CAST(floor(amount / 100) AS INT) AS target FROM steps WHERE event_type = 'purchase'),
c AS (SELECT *, CASE WHEN lag(target) OVER w IS DISTINCT FROM target THEN 1 ELSE 0 END AS ch FROM p WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY event_id) AS island FROM c)
SELECT session_id, event_id, target, CAST(row_number() OVER (PARTITION BY session_id, island ORDER BY event_id) AS BIGINT) AS run FROM i""",
    "steps",
)
def same_target_run(spark, sf):
    p = src.steps(spark, sf).filter("event_type = 'purchase'").selectExpr(
        "session_id", "event_id", "CAST(floor(amount / 100) AS INT) AS target"
    )
    return rp.run_length(p, SESSION, ORDER, F.col("target"), "run")


@query(
    "wi4_state_history",
    """SELECT session_id, event_id, state FROM (SELECT session_id, event_id, event_type AS state, lag(event_type) OVER (PARTITION BY session_id ORDER BY event_id) AS prev FROM steps) WHERE prev IS DISTINCT FROM state""",
    "steps",
)
def state_history(spark, sf):
    s = src.steps(spark, sf).selectExpr("session_id", "event_id", "event_type AS state")
    return rp.changes(s, SESSION, ORDER, F.col("state"))


CAPS = case("name", vocab.CAPACITY)
APART = "(({0}.x - {1}.x) * ({0}.x - {1}.x) + ({0}.y - {1}.y) * ({0}.y - {1}.y))".format
# sites by recursion over the distinct points of a name in the order of their first sighting
SITES = f"""s AS (SELECT f.session_id, t.name, t.x, t.y, f.frame_id, t.det_no, f.step, {CAPS} + CASE WHEN t.det_no = 9223372036854775807 THEN 0 ELSE CAST(t.det_no % 700 AS INT) END AS cap, t.det_no % 3 = 0 AS deploy
  FROM targets t JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_id) AS step FROM frames) f USING (frame_id)),
pt AS (SELECT *, row_number() OVER (PARTITION BY session_id, name ORDER BY first) AS k FROM (SELECT session_id, name, x, y, min(ROW(frame_id, det_no)) AS first FROM s GROUP BY ALL)),
fd AS (SELECT session_id, name, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x INT, y INT)[]) AS found FROM pt GROUP BY session_id, name
  UNION ALL SELECT pt.session_id, pt.name, pt.k, CASE WHEN len(list_filter(fd.found, lambda q: {APART('q', 'pt')} <= 1024)) > 0 THEN fd.found ELSE list_append(fd.found, {{'x': pt.x, 'y': pt.y}}) END
  FROM fd JOIN pt ON pt.session_id = fd.session_id AND pt.name = fd.name AND pt.k = fd.k + 1),
st AS (SELECT s.*, list_filter(fl.found, lambda q: {APART('q', 's')} <= 1024)[1] AS site FROM s JOIN (SELECT session_id, name, arg_max(found, k) AS found FROM fd GROUP BY session_id, name) fl USING (session_id, name)),
sm AS (SELECT *, site.x AS site_x, site.y AS site_y, CAST(count(*) OVER w AS BIGINT) AS times_seen, max(cap) OVER w AS max_capacity FROM st
  WINDOW w AS (PARTITION BY session_id, name, site.x, site.y ORDER BY frame_id, det_no))"""
SITE = ["session_id", "name", "site_x", "site_y"]


def numbered_frames(spark, sf):
    """Frames with the number of their tick in the session."""
    return ordered(src.frames(spark, sf).select("frame_id", "session_id"), SESSION, ["frame_id"]).row_number("step").result()


def capacity_of(name, det_no):
    return vocab.lookup(name, vocab.CAPACITY) + (det_no % 700).cast("int")


def sites(spark, sf):
    t = src.targets(spark, sf).join(numbered_frames(spark, sf), "frame_id")
    t = t.select("session_id", "name", "x", "y", "frame_id", "det_no", "step", capacity_of(F.col("name"), F.col("det_no")).alias("cap"), (F.col("det_no") % 3 == 0).alias("deploy"))
    return st.with_sites(t, ["session_id", "name"], ["frame_id", "det_no"])


@query(
    "wi5_site_memory",
    f"WITH RECURSIVE {SITES} SELECT session_id, name, site_x, site_y, frame_id, det_no, times_seen, CAST(max_capacity AS INT) AS max_capacity, CAST(step AS BIGINT) AS last_seen FROM sm",
    "targets frames",
)
def site_memory(spark, sf):
    m = st.site_memory(sites(spark, sf), ["session_id", "name"], ["frame_id", "det_no"], F.col("cap"), "step")
    return m.select(*SITE, "frame_id", "det_no", "times_seen", "max_capacity", "last_seen")


SITE_TABLE = f"""WITH RECURSIVE {SITES}, a AS (SELECT session_id, name, site_x, site_y, CAST(count(*) AS BIGINT) AS seen, CAST(max(cap) AS BIGINT) AS capacity, CAST(count(*) FILTER (deploy) AS BIGINT) AS deploys, CAST(max(step) AS BIGINT) AS last_seen FROM sm GROUP BY ALL),
b AS (SELECT *, CASE WHEN deploys <= 0 THEN 0 ELSE least(capacity, greatest(0, deploys - 1) * 1000) END AS looted, CAST(ceil(capacity / 1000) AS BIGINT) + 1 AS needed FROM a)"""


def site_table(spark, sf):
    a = sites(spark, sf).groupBy(*SITE).agg(
        lb.count_rows("seen"), F.max("cap").cast("bigint").alias("capacity"), F.count_if("deploy").alias("deploys"), F.max("step").alias("last_seen")
    )
    d = st.depletion(F.col("capacity"), F.col("deploys"), F.col("seen"), F.lit(0), F.lit(1))
    return a.withColumns(d)


@query("so6_site_depletion", f"{SITE_TABLE} SELECT session_id, name, site_x, site_y, seen >= 2 AND (capacity - looted <= 0 OR deploys >= needed) AS depleted FROM b", "targets frames")
def site_depletion(spark, sf):
    return site_table(spark, sf).select(*SITE, "depleted")


@query(
    "ag26_site_table",
    f"{SITE_TABLE} SELECT session_id, name, site_x, site_y, seen, last_seen, capacity, deploys, CAST(looted AS BIGINT) AS looted, CAST(greatest(0, capacity - looted) AS BIGINT) AS remaining, needed FROM b",
    "targets frames",
)
def site_report(spark, sf):
    return site_table(spark, sf).select(*SITE, "seen", "last_seen", "capacity", "deploys", "looted", "remaining", "needed")


# --- frame vectors ---------------------------------------------------------------------------------


def vectors(spark, sf):
    return src.table(spark, sf, "embeddings").select(F.col("label").alias("video"), "vec_id", "embedding")


MAD = "(list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len({a}))"


@query(
    "fn14_frame_difference",
    f"""SELECT video, vec_id, round({MAD.format(a='embedding', b='prev')}, 6) AS diff FROM (SELECT label AS video, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings)""",
)
def frame_difference(spark, sf):
    o = ordered(vectors(spark, sf), ["video"], ["vec_id"]).previous("prev", F.col("embedding")).result()
    return o.select("video", "vec_id", F.round(rp.mean_abs_difference(F.col("embedding"), F.col("prev")), 6).alias("diff"))


@query(
    "wi6_frame_filter",
    f"""WITH RECURSIVE v AS (SELECT video, vec_id, embedding, row_number() OVER (PARTITION BY video ORDER BY vec_id) AS k FROM (
  SELECT label AS video, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE (n - 1) % 2 = 0),
r AS (SELECT video, vec_id, k, embedding AS last, true AS kept FROM v WHERE k = 1
  UNION ALL SELECT v.video, v.vec_id, v.k, CASE WHEN {MAD.format(a='v.embedding', b='r.last')} < 0.14 THEN r.last ELSE v.embedding END, {MAD.format(a='v.embedding', b='r.last')} >= 0.14
  FROM r JOIN v ON v.video = r.video AND v.k = r.k + 1)
SELECT video, vec_id, CAST(row_number() OVER (PARTITION BY video ORDER BY vec_id) AS BIGINT) AS n_kept FROM r WHERE kept""",
)
def frame_filter(spark, sf):
    return rp.keep_changed_frames(vectors(spark, sf), ["video"], ["vec_id"], "embedding", 2, 0.14, 2000)


@query(
    "sc12_stride_sample",
    """WITH r AS (SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY lpad(o_orderkey::VARCHAR, 20, '0')) - 1 AS rn, count(*) OVER () AS n FROM orders),
i AS (SELECT DISTINCT CAST(floor(i * (SELECT count(*) FROM orders) / 200) AS BIGINT) AS rn FROM range(200) t(i))
SELECT frame_id, CAST(rn AS BIGINT) AS pos FROM r WHERE rn IN (SELECT rn FROM i)""",
)
def stride_sample(spark, sf):
    # wide enough for any BIGINT, so text order is the order of numbers
    frames = src.frames(spark, sf).select("frame_id", F.lpad(F.col("frame_id").cast("string"), 20, "0").alias("path"))
    ranked = global_rank(frames, ["path"], "rn").withColumn("pos", F.col("rn") - 1)
    return stride_sample_of(ranked, frames.agg(F.count("*").alias("n")), 200)


def stride_sample_of(ranked, total, cap):
    """Rows at ``cap`` even steps of ``pos``; all rows, if there are no more. ``total`` is one row (n)."""
    steps = ranked.sparkSession.range(cap).crossJoin(total)
    wanted = steps.select(F.floor(F.col("id") * F.col("n") / F.lit(cap)).alias("pos")).distinct()
    return ranked.join(F.broadcast(wanted), "pos", "left_semi").select("frame_id", "pos")


# --- ledger and arbitration -------------------------------------------------------------------------


@query(
    "wi10_resource_ledger",
    """WITH RECURSIVE e AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k,
  CASE event_type WHEN 'purchase' THEN CAST(round(amount * 100) AS BIGINT) WHEN 'click' THEN -CAST(round(amount * 100) AS BIGINT) ELSE 0 END AS d FROM steps),
r AS (SELECT session_id, event_id, k, greatest(0, d) AS balance FROM e WHERE k = 1
  UNION ALL SELECT e.session_id, e.event_id, e.k, greatest(0, r.balance + e.d) FROM r JOIN e ON e.session_id = r.session_id AND e.k = r.k + 1)
SELECT session_id, event_id, CAST(balance AS BIGINT) AS balance FROM r""",
    "steps",
)
def resource_ledger(spark, sf):
    cents = F.expr("CAST(round(amount * 100) AS BIGINT)")
    s = src.steps(spark, sf).select(
        "session_id", "event_id",
        F.when(F.col("event_type") == "purchase", cents).when(F.col("event_type") == "click", -cents).otherwise(0).alias("d"),
    )
    return rp.ledger(s, SESSION, ORDER, F.col("d"), "balance").drop("d")


VILLAGE_COLS = """amount * 20000 AS gold, event_type = 'signup' AS collectible, event_type = 'error' AS blocked,
 CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2000000 END AS required, CASE WHEN event_id % 2 = 0 THEN 3000000 ELSE 0 END AS cost, CASE WHEN event_id % 5 = 0 THEN 700 ELSE 0 END AS missing"""


@query(
    "so5_ring_arbitration",
    f"""WITH v AS (SELECT session_id, event_id, {VILLAGE_COLS} FROM steps),
g AS (SELECT *, coalesce(last_value(CASE WHEN NOT collectible AND NOT blocked THEN CASE WHEN gold >= 1500000 THEN false WHEN gold <= 500000 THEN true END END IGNORE NULLS) {OVER}, false) AS low,
  coalesce(nullif(required, 0), nullif(cost, 0), 0) AS need FROM v)
SELECT session_id, event_id, CASE WHEN collectible THEN 'collect' WHEN blocked AND need > 0 AND gold >= need THEN 'donate' WHEN blocked THEN 'farm' WHEN low THEN 'farm' ELSE 'donate' END AS ring,
  CASE WHEN collectible OR (blocked AND need > 0 AND gold >= need) THEN NULL WHEN blocked THEN greatest(1, coalesce(nullif(missing, 0), nullif(required, 0), nullif(cost, 0), 1)) WHEN low THEN 1500000 END AS objective FROM g""",
    "steps",
)
def ring_arbitration(spark, sf):
    v = src.steps(spark, sf).selectExpr("session_id", "event_id", VILLAGE_COLS.split(",")[0], *[c.strip() for c in VILLAGE_COLS.split(",")[1:]])
    low, resume = vocab.THRESHOLDS["gold"]
    # the gate is asked, and moves, only on rows that reach it
    reached = ~F.col("collectible") & ~F.col("blocked")
    g = rp.hysteresis(v, SESSION, ORDER, F.col("gold"), low, resume, "low", reached)
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    need = F.coalesce(some("required"), some("cost"), F.lit(0))
    covered = F.col("blocked") & (need > 0) & (F.col("gold") >= need)
    gap = F.greatest(F.lit(1), F.coalesce(some("missing"), some("required"), some("cost"), F.lit(1)))
    ring = (
        F.when(F.col("collectible"), "collect").when(covered, "donate").when(F.col("blocked"), "farm")
        .when(F.col("low"), "farm").otherwise("donate")
    )
    goal = F.when(F.col("collectible") | covered, None).when(F.col("blocked"), gap).when(F.col("low"), F.lit(max(1, resume)))
    return g.select("session_id", "event_id", ring.alias("ring"), goal.alias("objective"))


@query(
    "so7_low_requirements",
    f"""WITH {GATE} SELECT session_id, event_id, CASE WHEN flagged THEN [1500000] ELSE [] END AS gold_goal FROM g""",
    "steps",
)
def low_requirements(spark, sf):
    s = src.steps(spark, sf).select("session_id", "event_id", "amount")
    g = rp.hysteresis(s, SESSION, ORDER, F.col("amount"), 20, 100, "flagged")
    goals = F.map_from_entries(F.array_compact(F.array(
        F.when(F.col("flagged"), F.struct(F.lit("gold").alias("k"), F.lit(max(1, vocab.THRESHOLDS["gold"][1])).alias("v")))
    )))
    return g.select("session_id", "event_id", F.map_values(goals).alias("gold_goal"))


# --- state machines ---------------------------------------------------------------------------------------


def battle_signals(spark, sf):
    return src.steps(spark, sf).withColumns({
        "all_full": F.expr("amount >= 489"),
        "worth": F.expr("CASE WHEN event_type = 'purchase' AND amount < 20 THEN false END"),
    })


SIG = """sg AS (SELECT *, amount >= 489 AS all_full, CASE WHEN event_type = 'purchase' AND amount < 20 THEN false END AS worth, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM steps)"""
BATTLE = f"""WITH RECURSIVE {SIG}, r AS (SELECT session_id, CAST(NULL AS BIGINT) AS event_id, 0::BIGINT AS k, 'V' AS s, 0 AS streak, '' AS action FROM sg GROUP BY session_id
  UNION ALL SELECT g.session_id, g.event_id, g.k,
   CASE r.s WHEN 'V' THEN CASE WHEN all_full THEN 'X' WHEN attack THEN 'S' ELSE 'V' END
     WHEN 'S' THEN CASE WHEN return_b AND NOT next_b THEN 'V' WHEN search THEN 'S' WHEN coalesce(worth, n_targets > 0) AND n_targets > 0 THEN 'B' ELSE 'S' END
     WHEN 'B' THEN CASE WHEN n_targets > 0 THEN 'B' WHEN return_b THEN 'O' WHEN end_b AND streak + 1 >= 3 THEN 'O' ELSE 'B' END
     WHEN 'O' THEN CASE WHEN return_b THEN 'V' ELSE 'O' END ELSE 'X' END,
   CASE WHEN r.s <> 'B' THEN 0 WHEN n_targets > 0 THEN 0 WHEN return_b THEN streak WHEN end_b THEN streak + 1 ELSE streak END,
   CASE r.s WHEN 'V' THEN CASE WHEN all_full THEN 'stop' WHEN attack THEN 'tap 进攻按钮' ELSE 'wait' END
     WHEN 'S' THEN CASE WHEN return_b AND NOT next_b THEN 'tap 返回按钮' WHEN search THEN 'tap 搜索对手按钮' WHEN coalesce(worth, n_targets > 0) AND n_targets > 0 THEN 'deploy' WHEN next_b THEN 'tap 下一个按钮' ELSE 'wait' END
     WHEN 'B' THEN CASE WHEN n_targets > 0 THEN 'deploy' WHEN return_b THEN 'wait' WHEN end_b AND streak + 1 >= 3 THEN 'tap 结束战斗按钮' ELSE 'wait' END
     WHEN 'O' THEN CASE WHEN return_b THEN 'tap 返回按钮' ELSE 'wait' END ELSE 'stop' END
  FROM r JOIN sg g ON g.session_id = r.session_id AND g.k = r.k + 1)
SELECT session_id, event_id, {case('s', {'V': '村庄待机', 'S': '搜索中', 'B': '战斗中', 'O': '战斗结束', 'X': '停止'})} AS state, action FROM r WHERE k > 0"""


@query("st1_battle_replay", BATTLE, "steps")
def battle_replay(spark, sf):
    return ma.replay(battle_signals(spark, sf), SESSION, ORDER, ma.battle_machine())


DON = """event_type = 'click' AS list_b, event_type = 'view' AS request, event_type = 'error' AS close_b, event_type = 'signup' AS reinforce,
 event_type = 'purchase' AND amount >= 50 AS confirm, event_type = 'purchase' AS troops, amount < 200 AS enough, CASE WHEN event_id % 2 = 0 THEN true WHEN event_id % 3 = 0 THEN false END AS more"""


@query(
    "st2_donation_replay",
    f"""WITH RECURSIVE sg AS (SELECT session_id, event_id, {DON}, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM steps),
r AS (SELECT session_id, CAST(NULL AS BIGINT) AS event_id, 0::BIGINT AS k, 'V' AS s, '' AS action FROM sg GROUP BY session_id
  UNION ALL SELECT g.session_id, g.event_id, g.k,
   CASE r.s WHEN 'V' THEN CASE WHEN list_b THEN 'L' ELSE 'V' END
     WHEN 'L' THEN CASE WHEN close_b AND NOT request THEN 'V' WHEN request AND enough THEN 'D' WHEN request THEN 'K' ELSE 'L' END
     WHEN 'K' THEN CASE WHEN request AND enough THEN 'D' WHEN request THEN 'K' WHEN list_b THEN 'L' ELSE 'K' END
     WHEN 'D' THEN CASE WHEN reinforce THEN 'G' WHEN close_b THEN 'V' ELSE 'D' END
     WHEN 'G' THEN CASE WHEN troops THEN 'H' ELSE 'G' END WHEN 'H' THEN CASE WHEN confirm THEN 'F' ELSE 'H' END
     ELSE CASE WHEN close_b AND more THEN 'L' WHEN close_b THEN 'V' ELSE 'F' END END,
   CASE r.s WHEN 'V' THEN CASE WHEN list_b THEN 'tap 消息列表按钮' ELSE 'wait' END
     WHEN 'L' THEN CASE WHEN close_b AND NOT request THEN 'tap 关闭按钮' WHEN request AND enough THEN 'tap 请求条目' WHEN request THEN 'blocked' ELSE 'wait' END
     WHEN 'K' THEN CASE WHEN request AND enough THEN 'tap 请求条目' WHEN request THEN 'blocked' WHEN list_b THEN 'tap 消息列表按钮' ELSE 'wait' END
     WHEN 'D' THEN CASE WHEN reinforce THEN 'tap 增援按钮' WHEN close_b THEN 'tap 关闭按钮' ELSE 'wait' END
     WHEN 'G' THEN CASE WHEN troops THEN 'tap 兵种选择栏' ELSE 'wait' END WHEN 'H' THEN CASE WHEN confirm THEN 'tap 捐赠确认按钮' ELSE 'wait' END
     ELSE CASE WHEN close_b THEN 'tap 关闭按钮' ELSE 'wait' END END
  FROM r JOIN sg g ON g.session_id = r.session_id AND g.k = r.k + 1)
SELECT session_id, event_id, {case('s', {'V': '村庄待机', 'L': '捐兵-消息列表', 'K': '捐兵-资源不足阻塞', 'D': '捐兵-请求详情', 'G': '捐兵-增援中', 'H': '捐兵-增援中', 'F': '捐兵-完成'})} AS state, action FROM r WHERE k > 0""",
    "steps",
)
def donation_replay(spark, sf):
    s = src.steps(spark, sf).selectExpr("*", *[c.strip() for c in DON.replace("\n", " ").split(",")])
    return ma.replay(s, SESSION, ORDER, ma.donation_machine())


@query(
    "st3_farm_replay",
    f"""WITH RECURSIVE {SIG}, r AS (SELECT session_id, CAST(NULL AS BIGINT) AS event_id, 0::BIGINT AS k, 'V' AS s, '' AS action FROM sg GROUP BY session_id
  UNION ALL SELECT g.session_id, g.event_id, g.k,
   CASE r.s WHEN 'V' THEN CASE WHEN all_full THEN 'X' WHEN attack THEN 'B' ELSE 'V' END WHEN 'B' THEN CASE WHEN return_b THEN 'O' ELSE 'B' END WHEN 'O' THEN 'V' ELSE 'X' END,
   CASE r.s WHEN 'V' THEN CASE WHEN all_full THEN 'stop' WHEN attack THEN 'tap 进攻按钮' ELSE 'wait' END
     WHEN 'B' THEN CASE WHEN return_b THEN 'wait' WHEN n_targets > 0 THEN 'deploy' ELSE 'wait' END WHEN 'O' THEN 'tap 返回按钮' ELSE 'stop' END
  FROM r JOIN sg g ON g.session_id = r.session_id AND g.k = r.k + 1)
SELECT session_id, event_id, {case('s', {'V': '村庄待机', 'B': '战斗中', 'O': '战斗结束', 'X': '停止'})} AS state, action FROM r WHERE k > 0""",
    "steps",
)
def farm_replay(spark, sf):
    return ma.replay(battle_signals(spark, sf), SESSION, ORDER, ma.farm_machine())


@query(
    "st4_collector_replay",
    f"""SELECT session_id, event_id, CASE WHEN n_targets > 0 THEN '村庄-采集中' ELSE '采集完成' END AS state,
  CASE WHEN n_targets > 0 THEN concat('tap ', coalesce({case('n_targets % 4', {0: '金币采集图标', 1: '圣水采集图标', 2: '黑油采集图标'})}, '金币采集图标')) ELSE 'stop' END AS action FROM steps""",
    "steps",
)
def collector_replay(spark, sf):
    """This machine forgets its state in every step, so each row stands for itself."""
    kinds = dict(enumerate(vocab.COLLECT_ICONS))
    icon = vocab.lookup(vocab.lookup(F.col("n_targets") % 4, kinds), vocab.COLLECT_ICONS, "金币采集图标")
    some = F.col("n_targets") > 0
    return src.steps(spark, sf).select(
        "session_id", "event_id", F.when(some, "村庄-采集中").otherwise("采集完成").alias("state"),
        F.when(some, F.concat(F.lit("tap "), icon)).otherwise("stop").alias("action"),
    )


# local detections and requested places under the name of the view that the scores are written on
CANDIDATES = f"""lt AS ({VIEWS['targets']}), {sq.REQ},
targets AS (SELECT frame_id, det_no, name, x, y FROM lt UNION ALL SELECT frame_id, 9223372036854775807, r_name, rx, ry FROM req r WHERE r_name IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM lt WHERE lt.frame_id = r.frame_id AND lt.name = r.r_name AND (lt.x - rx) * (lt.x - rx) + (lt.y - ry) * (lt.y - ry) <= 2304))"""
ROTATION = f"""WITH RECURSIVE {CANDIDATES}, {sq.FULL}, {sq.NEAR_DEF}, {sq.LANDED}, {sq.score_sql(True)}, {SITES},
me AS (SELECT session_id, name, site_x, site_y, frame_id, max(times_seen) AS seen, max(max_capacity) AS capacity FROM sm GROUP BY ALL),
ca AS (SELECT sm.session_id, sc.frame_id, sc.det_no, sc.name, sc.x, sc.y, sc.score, sm.site_x, sm.site_y, me.seen, CAST(me.capacity AS BIGINT) AS capacity, l.px, l.py, 3 * least(2, coalesce(lw.layers, 0)) AS wall,
  CASE WHEN sqrt(l.d2::DOUBLE) > 120 THEN CAST(ceil((sqrt(l.d2::DOUBLE) - 120) / 180) AS INT) ELSE 0 END AS walk,
  CASE WHEN sqrt(l.d2::DOUBLE) > 120 THEN greatest(0.35::DOUBLE, 1 - least(1, (sqrt(l.d2::DOUBLE) - 120) / 140) * 0.8::DOUBLE) ELSE 1.0::DOUBLE END AS factor,
  coalesce(sc.name = r_name AND (sc.x - rx) * (sc.x - rx) + (sc.y - ry) * (sc.y - ry) <= 2304, false) AS asked, coalesce(sc.name = r_name, false) AS of_name
  FROM sc JOIN sm USING (frame_id, det_no) JOIN me ON me.session_id = sm.session_id AND me.name = sm.name AND me.site_x = sm.site_x AND me.site_y = sm.site_y AND me.frame_id = sm.frame_id
  JOIN land l ON l.frame_id = sc.frame_id AND l.det_no = sc.det_no LEFT JOIN lw ON lw.frame_id = sc.frame_id AND lw.det_no = sc.det_no JOIN nd ON nd.frame_id = sc.frame_id AND nd.det_no = sc.det_no
  LEFT JOIN req ON req.frame_id = sc.frame_id
  WHERE sqrt(l.d2::DOUBLE) <= 260 AND CASE WHEN nd.defence_px IS NULL THEN 0.1::DOUBLE ELSE least(1, greatest(0, 1 - nd.defence_px / 200)) END <= 0.8::DOUBLE),
tk AS (SELECT session_id, frame_id, row_number() OVER (PARTITION BY session_id ORDER BY frame_id) AS k, list(ca ORDER BY score DESC, det_no) AS cs FROM ca GROUP BY session_id, frame_id),
ro AS (SELECT session_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS STRUCT(name VARCHAR, x INT, y INT)) AS last, CAST(0 AS BIGINT) AS repeats,
  CAST([] AS STRUCT(name VARCHAR, sx INT, sy INT, wall BIGINT, walk BIGINT, needed BIGINT)[]) AS hits, CAST(NULL AS STRUCT(name VARCHAR, x INT, y INT, px INT, py INT, score DOUBLE, reason VARCHAR, n BIGINT, wall BIGINT, walk BIGINT, needed BIGINT, loot BIGINT)) AS plan
  FROM tk GROUP BY session_id
  UNION ALL SELECT session_id, k, frame_id, CASE WHEN n = 0 THEN last ELSE {{'name': pick.c.name, 'x': pick.c.x, 'y': pick.c.y}} END, CASE WHEN n = 0 THEN repeats ELSE now_repeats END,
  CASE WHEN n = 0 THEN hits ELSE list_append(hits, {{'name': pick.c.name, 'sx': pick.c.site_x, 'sy': pick.c.site_y, 'wall': way.c.wall, 'walk': way.c.walk, 'needed': way.needed}}) END,
  CASE WHEN n = 0 THEN NULL ELSE {{'name': pick.c.name, 'x': pick.c.x, 'y': pick.c.y, 'px': way.c.px, 'py': way.c.py, 'score': pick.c.score,
    'reason': CASE WHEN same AND now_repeats >= 2 THEN CASE WHEN n = 1 THEN 'repeat_limit_only_candidate' ELSE 'repeat_limit_reached' END WHEN last IS NOT NULL AND NOT same AND repeats >= 2 THEN 'rotated_after_repeat_limit'
      WHEN pick.c.of_name THEN 'requested_target_honored' WHEN n = 1 THEN 'only_candidate' ELSE 'top_scored_target' END, 'n': n, 'wall': way.c.wall, 'walk': way.c.walk, 'needed': way.needed, 'loot': way.loot}} END
  FROM (SELECT *, CASE WHEN same THEN repeats + 1 ELSE 1 END AS now_repeats FROM (SELECT *, list_filter(q, lambda a: a.c.name = pick.c.name AND {APART('a.c', 'pick.c')} <= 2304)[1] AS way,
    coalesce(last.name = pick.c.name AND {APART('last', 'pick.c')} <= 2304, false) AS same
  FROM (SELECT *, CASE WHEN asked IS NOT NULL AND NOT asked.tired THEN asked ELSE coalesce(list_filter(q, lambda a: NOT a.tired)[1], q[1]) END AS pick
  FROM (SELECT *, len(q) AS n, list_filter(q, lambda a: a.c.asked)[1] AS asked
  FROM (SELECT session_id, k, frame_id, last, repeats, hits, list_filter(list_transform(list_transform(list_filter(list_transform(list_transform(list_transform(cs,
      lambda a: {{'c': a, 'h': list_filter(hits, lambda h: h.name = a.name AND h.sx = a.site_x AND h.sy = a.site_y)}}),
      lambda a: {{'c': a.c, 'd': len(a.h), 'm': a.h[-1]}}),
      lambda a: {{'c': a.c, 'left_over': greatest(0, a.c.capacity - CASE WHEN a.d > 0 THEN least(a.c.capacity, greatest(0, a.d - a.m.wall - a.m.walk) * 1000) ELSE 0 END), 'd': a.d, 'full_at': coalesce(a.m.needed, CAST(ceil(a.c.capacity / 1000) AS BIGINT))}}),
      lambda a: NOT (a.c.seen >= 2 AND (a.left_over <= 0 OR a.d >= a.full_at))),
      lambda a: {{'c': a.c, 'left_over': a.left_over, 'base': CAST(ceil(a.left_over / 1000) AS BIGINT), 'tired': coalesce(repeats >= 2 AND last.name = a.c.name AND {APART('last', 'a.c')} <= 2304, false)}}),
      lambda a: {{'c': a.c, 'tired': a.tired, 'left_over': a.left_over, 'needed': a.base + a.c.wall + a.c.walk, 'loot': CAST(least(a.left_over, trunc(a.base * 1000 * a.c.factor), trunc(greatest(0, 30 - a.c.wall - a.c.walk) * 1000 * a.c.factor)) AS BIGINT)}}),
      lambda a: a.needed <= 30 AND a.left_over > 0 AND a.loot >= 400) AS q
  FROM (SELECT ro.session_id, tk.k, tk.frame_id, ro.last, ro.repeats, ro.hits, tk.cs FROM ro JOIN tk ON tk.session_id = ro.session_id AND tk.k = ro.k + 1))))))
)
SELECT session_id, frame_id, plan.name AS name, plan.x AS x, plan.y AS y, plan.px AS land_x, plan.py AS land_y, plan.score AS score, CAST(repeats AS INT) AS repeats, plan.reason AS reason, plan.n AS n_candidates,
  CAST(plan.wall AS INT) AS wall_cost, CAST(plan.walk AS INT) AS walk_extra, plan.needed AS troops_needed, plan.loot AS expected_loot FROM ro WHERE plan IS NOT NULL"""


@query("st5_target_rotation", ROTATION, "det defences landable walls frames")
def target_rotation(spark, sf):
    t = src.targets(spark, sf).select("frame_id", "det_no", "name", "x", "y", capacity_of(F.col("name"), F.col("det_no")).alias("cap"))
    ranked = rt.candidates(t, numbered_frames(spark, sf), sq.requests(spark, sf), src.frame_points(spark, sf), src.walls(spark, sf), sq.full_resources(spark, sf), (W, H))
    return rt.rotate_targets(ranked)


TRACE = """t AS (SELECT session_id, event_id, CASE event_id % 3 WHEN 0 THEN 'village' WHEN 1 THEN 'farm' ELSE 'donate' END AS ring,
  CASE event_type WHEN 'click' THEN 'BLOCKED' WHEN 'view' THEN 'LOW' WHEN 'signup' THEN 'SUCCESS' WHEN 'purchase' THEN 'BLOCKED' ELSE 'ERROR' END AS status FROM steps)"""


def traced(spark, sf):
    return src.steps(spark, sf).select(
        "session_id", "event_id", F.expr("CASE event_id % 3 WHEN 0 THEN 'village' WHEN 1 THEN 'farm' ELSE 'donate' END").alias("ring"),
        F.expr("CASE event_type WHEN 'click' THEN 'BLOCKED' WHEN 'view' THEN 'LOW' WHEN 'signup' THEN 'SUCCESS' WHEN 'purchase' THEN 'BLOCKED' ELSE 'ERROR' END").alias("status"),
    )


def trace_sql(terminal: str) -> str:
    return f"""WITH {TRACE}, x AS (SELECT session_id, min(event_id) AS stop FROM t WHERE {terminal} GROUP BY 1)
SELECT t.* FROM t LEFT JOIN x USING (session_id) WHERE stop IS NULL OR event_id <= stop"""


VILLAGE_END = "status IN ('ERROR', 'MAX_STEPS') OR (ring <> 'farm' AND status NOT IN ('BLOCKED', 'LOW'))"
LEGACY_END = "status IN ('ERROR', 'MAX_STEPS') OR (ring = 'donate' AND status IN ('SUCCESS', 'STOP'))"


@query("st10_loop_trace_village_first", trace_sql(VILLAGE_END), "steps")
def loop_trace_village_first(spark, sf):
    return rp.until_terminal(traced(spark, sf), SESSION, "event_id", F.expr(VILLAGE_END))


@query("st10_loop_trace_legacy", trace_sql(LEGACY_END), "steps")
def loop_trace_legacy(spark, sf):
    return rp.until_terminal(traced(spark, sf), SESSION, "event_id", F.expr(LEGACY_END))


VERIFY = """CASE WHEN kind = 'deploy' THEN looted > 0 WHEN kind = 'tap' THEN coalesce(note, '') = '选中兵种' OR screen_changed ELSE true END"""
RESULTS = """CASE event_type WHEN 'purchase' THEN 'deploy' WHEN 'view' THEN 'tap' WHEN 'click' THEN 'tap' WHEN 'error' THEN 'stop' ELSE 'wait' END AS kind,
 CAST(floor(amount) AS BIGINT) - 3 AS looted, event_type = 'click' AND amount >= 2 AS screen_changed, CASE WHEN event_type = 'view' AND amount >= 1 THEN '选中兵种' END AS note"""


@query(
    "st11_task_verification",
    f"""WITH a AS (SELECT session_id, event_id, {RESULTS} FROM steps), v AS (SELECT session_id, event_id, kind, {VERIFY} AS verified FROM a),
x AS (SELECT session_id, min(event_id) AS stop, arg_min(CASE WHEN NOT verified THEN 'ERROR' ELSE 'STOP' END, event_id) AS status FROM v WHERE NOT verified OR kind = 'stop' GROUP BY 1)
SELECT v.session_id, coalesce(any_value(x.status), 'MAX_STEPS') AS status, CAST(count(*) AS BIGINT) AS n_steps, CAST(count(*) FILTER (verified) AS BIGINT) AS n_verified
FROM v LEFT JOIN x USING (session_id) WHERE stop IS NULL OR event_id <= stop GROUP BY v.session_id""",
    "steps",
)
def task_verification(spark, sf):
    a = src.steps(spark, sf).selectExpr("session_id", "event_id", *[c.strip() for c in RESULTS.replace("\n", " ").split(", ") if " AS " in c])
    v = a.select("session_id", "event_id", "kind", F.expr(VERIFY).alias("verified"))
    terminal = ~F.col("verified") | (F.col("kind") == "stop")
    kept = rp.until_terminal(v, SESSION, "event_id", terminal)
    ending = F.when(~F.col("verified"), "ERROR").when(F.col("kind") == "stop", "STOP")
    return kept.groupBy("session_id").agg(
        F.coalesce(F.max_by(ending, F.when(terminal, F.col("event_id"))), F.lit("MAX_STEPS")).alias("status"),
        lb.count_rows("n_steps"), F.count_if("verified").alias("n_verified"),
    )


@query(
    "st8_session_lifecycle",
    """WITH s AS (SELECT session_id, event_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY event_id) AS run FROM s)
SELECT session_id, min(ts) AS started, max(ts) AS finished, CAST(count(*) AS BIGINT) AS total_steps, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS executed,
  CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS corrected, round(count(*) FILTER (event_type = 'error') / count(*), 3) AS correction_rate FROM i GROUP BY session_id, run""",
    "steps",
)
def session_lifecycle(spark, sf):
    s = src.steps(spark, sf).select("session_id", "event_id", "ts", "event_type")
    o = ordered(s, SESSION, ORDER).previous("prev", F.col("ts"))
    fresh = F.when(F.col("ts") - F.col("prev") <= F.expr("INTERVAL '6' HOUR"), 0).otherwise(1)
    runs = o.running_sum("run", fresh.cast("bigint")).result()
    error = F.col("event_type") == "error"
    return runs.groupBy("session_id", "run").agg(
        F.min("ts").alias("started"), F.max("ts").alias("finished"), lb.count_rows("total_steps"),
        F.count_if(F.col("event_type") == "purchase").alias("executed"), F.count_if(error).alias("corrected"),
    ).withColumn("correction_rate", F.round(F.col("corrected") / F.col("total_steps"), 3)).drop("run")
