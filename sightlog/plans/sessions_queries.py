"""Queries on session logs, teacher reviews and teacher samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import text as tx
from sightlog.operators import labels as lb
from sightlog.operators import teacher as te
from sightlog.plans.registry import query
from sightlog.plans.views import case
from sightlog.sources import tables as src

STATE = dict(enumerate(vocab.STATES))
LS = case("state_id", {**{i: n for i, n in STATE.items() if i < 5}, 5: ""})
TS = case("corrected_id", {**STATE, 4: ""})
PAIRS = f"""l AS (SELECT session_id, step_no, executed, {LS} AS local_state FROM local_step),
t AS (SELECT session_id, step_no, approved, {TS} AS teacher_state FROM teacher_step)"""
PAIR_VIEWS = "local_step teacher_step"


def local(spark, sf):
    names = {**{i: n for i, n in STATE.items() if i < 5}, 5: ""}
    return src.local_steps(spark, sf).withColumn("local_state", vocab.lookup(F.col("state_id"), names))


def teacher(spark, sf):
    return src.teacher_steps(spark, sf).withColumn("teacher_state", vocab.lookup(F.col("corrected_id"), {**STATE, 4: ""}))


@query(
    "jo4_teacher_state_wins",
    f"""WITH {PAIRS} SELECT * FROM (SELECT l.session_id, l.step_no, coalesce(nullif(teacher_state, ''), nullif(local_state, '')) AS state
FROM l LEFT JOIN t USING (session_id, step_no)) WHERE state IS NOT NULL""",
    PAIR_VIEWS,
)
def teacher_state_wins(spark, sf):
    return te.step_states(local(spark, sf), teacher(spark, sf))


@query(
    "wi11_correction_overrides",
    f"""WITH {PAIRS} SELECT l.session_id, l.step_no, CASE WHEN NOT approved AND teacher_state <> '' THEN teacher_state ELSE local_state END AS state
FROM l LEFT JOIN t USING (session_id, step_no)""",
    PAIR_VIEWS,
)
def correction_overrides(spark, sf):
    j = local(spark, sf).join(teacher(spark, sf), ["session_id", "step_no"], "left")
    use = ~F.col("approved") & (F.col("teacher_state") != "")
    return j.select("session_id", "step_no", F.when(use, F.col("teacher_state")).otherwise(F.col("local_state")).alias("state"))


SUMMARY = f"""WITH {PAIRS} SELECT *, round(corrected / total_steps, 3) AS correction_rate FROM (SELECT l.session_id, CAST(count(*) AS BIGINT) AS total_steps,
  CAST(count(*) FILTER (approved) AS BIGINT) AS approved, CAST(count(*) FILTER (NOT approved) AS BIGINT) AS corrected,
  CAST(count(*) FILTER (executed) AS BIGINT) AS executed FROM l LEFT JOIN t USING (session_id, step_no) GROUP BY l.session_id)"""


@query("ag12_session_summary", SUMMARY, PAIR_VIEWS)
def session_summary(spark, sf):
    return te.session_summary(local(spark, sf), teacher(spark, sf))


@query(
    "sc6_step_file_pairs",
    f"WITH {PAIRS} SELECT CASE WHEN t.session_id IS NULL THEN 'local_only' ELSE 'paired' END AS kind, CAST(count(*) AS BIGINT) AS n FROM l LEFT JOIN t USING (session_id, step_no) GROUP BY 1",
    PAIR_VIEWS,
)
def step_file_pairs(spark, sf):
    t = src.teacher_steps(spark, sf).select("session_id", "step_no", F.lit(True).alias("has"))
    j = src.local_steps(spark, sf).join(t, ["session_id", "step_no"], "left")
    return j.groupBy(F.when(F.col("has").isNull(), "local_only").otherwise("paired").alias("kind")).agg(lb.count_rows("n"))


@query(
    "sc5_sessions_with_summary",
    "SELECT DISTINCT conv_id AS session_id FROM conversations WHERE role = 'system'",
)
def sessions_with_summary(spark, sf):
    return src.table(spark, sf, "conversations").filter("role = 'system'").selectExpr("conv_id AS session_id").distinct()


@query(
    "jo15_steps_of_summarised_sessions",
    "SELECT session_id, step_no FROM local_step WHERE session_id IN (SELECT conv_id FROM conversations WHERE role = 'system')",
    "local_step",
)
def steps_of_summarised_sessions(spark, sf):
    return src.local_steps(spark, sf).join(sessions_with_summary(spark, sf), "session_id", "left_semi").select("session_id", "step_no")


@query(
    "ag23_session_tail",
    """SELECT session_id, list(event_id ORDER BY event_id) AS last_steps FROM (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS rn FROM steps)
WHERE rn <= 30 GROUP BY session_id""",
    "steps",
)
def session_tail(spark, sf):
    s = src.steps(spark, sf).select("session_id", "event_id")
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("event_id")))
    tail = s.withColumn("rn", rn).filter("rn <= 30")
    return tail.groupBy("session_id").agg(F.array_sort(F.collect_list("event_id")).alias("last_steps"))


@query(
    "tk3_context_detections",
    """SELECT frame_id, list(det_no ORDER BY det_no) AS first_detections FROM (SELECT frame_id, det_no, row_number() OVER (PARTITION BY frame_id ORDER BY det_no) AS rn FROM det)
WHERE rn <= 15 GROUP BY frame_id""",
    "det",
)
def context_detections(spark, sf):
    rn = F.row_number().over(Window.partitionBy("frame_id").orderBy("det_no"))
    top = src.detections(spark, sf).select("frame_id", "det_no").withColumn("rn", rn).filter("rn <= 15")
    return top.groupBy("frame_id").agg(F.array_sort(F.collect_list("det_no")).alias("first_detections"))


# --- JSON from the teacher -------------------------------------------------------------------

OBJECT = """CASE det_no % 7
 WHEN 0 THEN concat('{"type": "', type, '", "coords": [', x2, '.5, ', y2, '], "confidence": ', class_id % 10, 'e-1}')
 WHEN 1 THEN concat('{"type": "', type, '", "coords": "', x2, ', ', y2, '"}')
 WHEN 2 THEN concat('{"type": "', type, '", "bbox": [', x1, ', ', y1, ', ', x2 + 1, ', ', y2, '], "confidence": 1.7}')
 WHEN 3 THEN concat('{"type": "", "coords": [', x2, ', ', y2, ']}')
 WHEN 4 THEN concat('{"type": "', type, '", "position_estimate": [', x1, ', ', y1, '], "coords": "near"}')
 WHEN 5 THEN '{"type": "x", "coords": [0, 5]}' ELSE concat('sorry, ', type) END"""


def teacher_payloads(spark, sf):
    return src.named_detections(spark, sf).select("frame_id", "det_no", F.expr(OBJECT).alias("payload"))


@query(
    "pr15_teacher_objects",
    """WITH o AS (SELECT frame_id, det_no, det_no % 7 AS m, type, x1, y1, x2, y2, class_id FROM named)
SELECT frame_id, det_no, type, CAST(CASE m WHEN 0 THEN round_even(x2 + 0.5::DOUBLE, 0) WHEN 1 THEN x2 WHEN 2 THEN round_even((x1 + x2 + 1) / 2, 0) ELSE x1 END AS BIGINT) AS x,
  CAST(CASE m WHEN 0 THEN y2 WHEN 1 THEN y2 WHEN 2 THEN round_even((y1 + y2) / 2, 0) ELSE y1 END AS BIGINT) AS y,
  CASE WHEN m = 0 AND class_id % 10 > 0 THEN (class_id % 10) / CAST(10 AS DOUBLE) ELSE 0.5 END AS confidence
FROM o WHERE m IN (0, 1, 2, 4) AND (m <> 4 OR (x1 > 0 AND y1 > 0))""",
    "named",
)
def teacher_objects(spark, sf):
    return te.objects_to_detections(teacher_payloads(spark, sf))


@query(
    "pr14_number_pairs",
    """WITH o AS (SELECT frame_id, det_no, det_no % 4 AS m, x1, y1, x2, y2 FROM det)
SELECT frame_id, det_no, CAST(CASE m WHEN 0 THEN x1 WHEN 1 THEN round_even((x1 + x2) / 2, 0) WHEN 2 THEN round_even(-x1 - 0.5::DOUBLE, 0) END AS BIGINT) AS x,
  CAST(CASE m WHEN 0 THEN y1 WHEN 1 THEN round_even((y1 + y2) / 2, 0) WHEN 2 THEN y1 END AS BIGINT) AS y FROM o""",
    "det",
)
def number_pairs(spark, sf):
    raw = F.expr(
        """CASE det_no % 4 WHEN 0 THEN concat('(', x1, '; ', y1, ')') WHEN 1 THEN concat('[', x1, ', ', y1, ', ', x2, ', ', y2, ']')
           WHEN 2 THEN concat('-', x1, '.5,', y1) ELSE concat('only ', x1) END"""
    )
    d = src.detections(spark, sf).select("frame_id", "det_no", raw.alias("raw"))
    return d.withColumn("p", tx.number_pair(F.col("raw"))).selectExpr("frame_id", "det_no", "p.x AS x", "p.y AS y")


SIZE, SEEN = (1600, 900), (1280, 720)
VERDICT = """CASE n % 6
 WHEN 0 THEN concat('{"approved": true, "reasoning": "ok ', n, '"}')
 WHEN 1 THEN concat('{"approved": false, "corrected_state": "搜索中", "corrected_action": {"kind": "tap", "target": "进攻按钮", "coords": [0.', n, ', 0.25]}}')
 WHEN 2 THEN concat('{"corrected_action": {"kind": "deploy", "target": "金矿", "coords": [', n, ', 301], "troop_coords": [0.5, -0.1]}, "resource_buildings": [{"type": "金矿", "center": [0.1, 0.', n, ']}, {"type": "墙", "center": [1, 1]}, {"type": "储金罐", "center": [', n, ', 77]}, {"type": "圣水瓶"}]}')
 WHEN 3 THEN concat('{"approved": false, "missed_objects": [{"type": "请求条目", "bbox": [0.1, 0.2, 0.3, 0.4]}, {"type": "关闭按钮", "bbox": [', n, ', 20, 300, 400]}, {"type": "x"}]}')
 WHEN 4 THEN '[1, 2]' ELSE concat('{"approved": tru', n) END"""


def verdict_payloads(spark, sf):
    return (
        src.table(spark, sf, "conversations").filter("role = 'assistant'")
        .selectExpr("conv_id AS session_id", "turn AS step_no", "length(text) AS n")
        .select("session_id", "step_no", F.expr(VERDICT).alias("payload"))
    )


V = "v AS (SELECT conv_id AS session_id, turn AS step_no, length(text) AS n, length(text) % 6 AS m, CAST('0.' || length(text) AS DOUBLE) AS f FROM conversations WHERE role = 'assistant')"


@query(
    "pr12_verdicts",
    f"""WITH {V} SELECT session_id, step_no, CASE WHEN m >= 4 THEN 'not an object' END AS error, m = 0 AS approved, CASE WHEN m = 1 THEN '搜索中' END AS corrected_state,
  CASE WHEN m = 0 THEN concat('ok ', n) WHEN m < 4 THEN '' END AS reasoning, CASE m WHEN 1 THEN 'tap' WHEN 2 THEN 'deploy' END AS kind, CASE m WHEN 1 THEN '进攻按钮' WHEN 2 THEN '金矿' END AS target,
  CAST(CASE m WHEN 1 THEN round_even(f * 1600, 0) WHEN 2 THEN round_even(n * 1600 / 1280, 0) END AS BIGINT) AS x,
  CAST(CASE m WHEN 1 THEN 225 WHEN 2 THEN round_even(301 * 900 / 720, 0) END AS BIGINT) AS y, CAST(NULL AS BIGINT) AS troop_x,
  CAST(CASE WHEN m = 3 THEN 3 ELSE 0 END AS INT) AS n_missed, CASE WHEN m = 3 THEN [n * 1600 / 1280, 20 * 900 / 960, 300 * 1600 / 1280, 400 * 900 / 960] END AS second_box FROM v""",
)
def verdicts(spark, sf):
    v = te.parse_verdicts(verdict_payloads(spark, sf), "payload", SIZE, SEEN)
    return v.selectExpr(
        "session_id", "step_no", "error", "approved", "corrected_state", "reasoning", "kind", "target", "coords.x AS x",
        "coords.y AS y", "troop_coords.x AS troop_x", "size(missed) AS n_missed", "get(missed, 1).bbox AS second_box",
    )


@query(
    "pr13_teacher_resources",
    f"""WITH {V} SELECT session_id, step_no, '金矿' AS type, 160::BIGINT AS x, CAST(round_even(f * 900, 0) AS BIGINT) AS y FROM v WHERE m = 2
UNION ALL SELECT session_id, step_no, '储金罐', CAST(round_even(n * 1600 / 1280, 0) AS BIGINT), CAST(round_even(77 * 900 / 720, 0) AS BIGINT) FROM v WHERE m = 2""",
)
def teacher_resources(spark, sf):
    v = te.parse_verdicts(verdict_payloads(spark, sf), "payload", SIZE, SEEN)
    return v.select("session_id", "step_no", F.explode("resources").alias("r")).selectExpr(
        "session_id", "step_no", "r.type AS type", "r.point.x AS x", "r.point.y AS y"
    )


@query(
    "pr11_normalised_points",
    """WITH p AS (SELECT frame_id, det_no, confidence AS fx, class_id / CAST(16 AS DOUBLE) - 0.05::DOUBLE AS fy FROM det)
SELECT frame_id, det_no, CASE WHEN fy >= 0 THEN CAST(round_even(fx * 1600, 0) AS BIGINT) END AS x, CASE WHEN fy >= 0 THEN CAST(round_even(fy * 900, 0) AS BIGINT) END AS y FROM p""",
    "det",
)
def normalised_points(spark, sf):
    d = src.detections(spark, sf).select(
        "frame_id", "det_no", F.array("confidence", F.col("class_id") / F.lit(16.0) - F.lit(0.05)).alias("p")
    )
    return d.withColumn("q", te.scaled_point(F.col("p"), SIZE, SEEN)).selectExpr("frame_id", "det_no", "q.x AS x", "q.y AS y")


@query(
    "pr17_plan_candidates",
    """SELECT frame_id, det_no, 0::INT AS pos, type AS name, x2 AS x, y2 AS y, 0.0::DOUBLE AS score, 'llm' AS source, concat('r', class_id) AS reason FROM named
UNION ALL SELECT frame_id, det_no, 2, '未知', 0, 0, 0.0, 'llm', '' FROM named""",
    "named",
)
def plan_candidates(spark, sf):
    text = F.expr(
        """concat('[{"action": "Deploy", "target": "', type, '", "coords": [', x2, '.9, ', y2, '], "reason": "r', class_id,
           '"}, {"action": "tap", "target": "', type, '"}, {"action": "deploy", "coords": "', x1, '"}]')"""
    )
    d = src.named_detections(spark, sf).select("frame_id", "det_no", text.alias("payload"))
    return te.plan_candidates(d, "payload")


@query(
    "pr24_typed_actions",
    """SELECT frame_id, det_no, kind, CASE WHEN det_no % 3 > 0 THEN target_id::VARCHAR END AS target, x, y, CAST(trunc(troop_x + 0.75) AS INT) AS troop_x, troop_y FROM actions WHERE target_id <> 8""",
    "actions",
)
def typed_actions(spark, sf):
    a = src.actions(spark, sf)
    pair = lambda x, y: F.when(F.col(x).isNotNull(), F.array(F.col(x) + 0.75, F.col(y) + 0.25))
    body = F.struct(
        F.when(F.col("target_id") != 8, F.col("kind")).alias("kind"),
        F.when(F.col("det_no") % 3 > 0, F.col("target_id").cast("string")).alias("target"),
        pair("x", "y").alias("coords"), pair("troop_x", "troop_y").alias("troop_coords"),
    )
    return te.parse_actions(a.select("frame_id", "det_no", F.to_json(body).alias("payload")), "payload")


@query(
    "fn9_fenced_json",
    """SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE concat('{"chars": ', n_chars, ', "lang": "', lang, '"}') END AS body FROM documents""",
)
def fenced_json(spark, sf):
    body = "concat('{\"chars\": ', n_chars, ', \"lang\": \"', lang, '\"}')"
    d = src.table(spark, sf, "documents").selectExpr(
        "doc_id",
        f"""CASE doc_id % 4 WHEN 0 THEN concat('Here:\n```json\n', {body}, '\n```\nbye') WHEN 1 THEN {body}
            WHEN 2 THEN concat('the answer is ', {body}, ' I think') ELSE concat('{{\"chars\": ', n_chars) END AS raw""",
    )
    return d.select("doc_id", tx.fenced_json(F.col("raw")).alias("body"))


@query(
    "fn18_safe_casts",
    """SELECT conv_id, turn, coalesce(TRY_CAST(w AS DOUBLE), 0) AS number, coalesce(TRY_CAST(CASE WHEN regexp_full_match(w, '[0-9]+') THEN w END AS BIGINT), -1) AS whole
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN length(text)::VARCHAR WHEN turn % 3 = 1 THEN split_part(text, ' ', 1) || 'x' ELSE length(text) || '.5' END AS w FROM conversations)""",
)
def safe_casts(spark, sf):
    w = F.expr(
        "CASE WHEN turn % 3 = 0 THEN CAST(length(text) AS STRING) WHEN turn % 3 = 1 THEN concat(split_part(text, ' ', 1), 'x') ELSE concat(length(text), '.5') END"
    )
    d = src.table(spark, sf, "conversations").select("conv_id", "turn", w.alias("w"))
    return d.selectExpr(
        "conv_id", "turn", "coalesce(try_cast(w AS DOUBLE), 0D) AS number",
        "coalesce(try_cast(CASE WHEN w RLIKE '^[0-9]+$' THEN w END AS BIGINT), -1L) AS whole",
    )


# --- teacher samples -----------------------------------------------------------------------------

SAMPLES = """s AS (SELECT doc_id AS name, doc_id % 11 <> 0 AS ok, doc_id % 13 <> 0 AS image, CASE WHEN doc_id % 17 <> 0 THEN sha256(text) END AS d, n_chars % 4 AS n_boxes, n_chars % 8 AS cls FROM documents),
f AS (SELECT *, CASE WHEN NOT ok THEN 'corrupt' WHEN NOT image THEN 'no_image' WHEN d IS NULL THEN 'mismatch' END AS early FROM s),
k AS (SELECT min(name) AS name FROM f WHERE early IS NULL GROUP BY d),
fate AS (SELECT name, n_boxes, cls, CASE WHEN early IS NOT NULL THEN early WHEN name NOT IN (SELECT name FROM k) THEN 'overlap' WHEN n_boxes = 0 THEN 'no_objects' ELSE 'converted' END AS fate FROM f)"""


def samples(spark, sf):
    """A sample per document: its meta text may be broken, its image (the text) may be missing."""
    meta = F.expr(
        """CASE WHEN doc_id % 11 = 0 THEN concat('{"image": "', doc_id) WHEN doc_id % 13 = 0 THEN '{"image": ""}'
           ELSE concat('{"image": "', doc_id, '.jpg"}') END"""
    )
    d = src.table(spark, sf, "documents")
    raw = d.select(
        F.col("doc_id").alias("name"), meta.alias("raw"),
        F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("content"),
        F.expr("CAST(n_chars % 4 AS INT)").alias("n_boxes"), F.expr("CAST(n_chars % 8 AS INT)").alias("class_id"),
    )
    parsed = F.when(tx.is_json(F.col("raw")), F.from_json("raw", "image STRING"))
    return raw.withColumn("meta", parsed).drop("raw")


@query("sc7_teacher_sample_scan", f"WITH {SAMPLES} SELECT CAST(name AS BIGINT) AS name, fate FROM fate")
def teacher_sample_scan(spark, sf):
    return te.sample_fate(samples(spark, sf)).select("name", "fate")


@query(
    "ag15_conversion_funnel",
    f"""WITH {SAMPLES} SELECT fate, CASE WHEN fate = 'converted' THEN CAST(cls AS INT) END AS class_id, CAST(count(*) AS BIGINT) AS n_samples,
  CAST(sum(CASE WHEN fate = 'converted' THEN n_boxes ELSE 0 END) AS BIGINT) AS n_boxes FROM fate GROUP BY ALL""",
)
def conversion_funnel(spark, sf):
    f = te.sample_fate(samples(spark, sf))
    done = F.col("fate") == "converted"
    return f.groupBy("fate", F.when(done, F.col("class_id")).alias("class_id")).agg(
        lb.count_rows("n_samples"), F.sum(F.when(done, F.col("n_boxes")).otherwise(0)).alias("n_boxes")
    )


@query(
    "jo17_first_of_equal_content",
    "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_copies FROM documents GROUP BY text",
)
def first_of_equal_content(spark, sf):
    return src.table(spark, sf, "documents").groupBy(tx.digest(F.col("text")).alias("digest")).agg(
        F.min("doc_id").alias("doc_id"), lb.count_rows("n_copies")
    )


@query("fn15_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", tx.digest(F.col("text")).alias("digest"))


@query(
    "sc11_resume_scan",
    """SELECT doc_id, 'pending' AS status, CAST(NULL AS INT) AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'cached', quality FROM labels""",
)
def resume_scan(spark, sf):
    done = src.table(spark, sf, "labels")
    todo = src.table(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left_anti")
    return todo.selectExpr("doc_id", "'pending' AS status", "CAST(NULL AS INT) AS quality").unionByName(
        done.selectExpr("doc_id", "'cached' AS status", "CAST(quality AS INT) AS quality")
    )


@query("jo16_pending_inputs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_inputs(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id").join(src.table(spark, sf, "labels"), "doc_id", "left_anti")


@query(
    "sc8_state_label_scan",
    f"""SELECT CAST(list_position({vocab.STATES}, expected_state) - 1 AS INT) AS state_id, CAST(count(DISTINCT t.frame_id) AS BIGINT) AS n_frames, CAST(count(d.frame_id) AS BIGINT) AS n_detections
FROM truth t LEFT JOIN det d USING (frame_id) WHERE expected_state IN {tuple(vocab.STATES)} AND expected_state <> '捐兵-消息列表' GROUP BY ALL""",
    "truth det",
)
def state_label_scan(spark, sf):
    dim = spark.createDataFrame([(i, n) for i, n in STATE.items() if n != "捐兵-消息列表"], "state_id INT, expected_state STRING")
    rows = src.ground_truth(spark, sf).join(F.broadcast(dim), "expected_state")
    n = src.detections(spark, sf).groupBy("frame_id").agg(lb.count_rows("n"))
    out = rows.join(n, "frame_id", "left").groupBy("state_id").agg(
        lb.count_rows("n_frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_detections")
    )
    # a scan without one valid sample is an error, not an empty result
    valid = out.agg(F.coalesce(F.sum("n_frames"), F.lit(0)).alias("valid"))
    checked = valid.select(F.when(F.col("valid") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no valid sample"))).alias("ok"))
    return out.join(F.broadcast(checked), how="cross").filter("ok").drop("ok")
