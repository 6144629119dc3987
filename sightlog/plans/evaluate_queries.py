"""Queries on frame signals, states, evaluation and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.operators import evaluate as ev
from sightlog.operators import labels as lb
from sightlog.operators import routing as rt
from sightlog.plans.boxes_queries import BASE_RULES, H, W
from sightlog.plans.registry import query
from sightlog.plans.views import case
from sightlog.sources import tables as src

SIG = list(ev.SIGNALS)
BUTTON = {s: ev.button_id(s) for s in SIG}

MODEL = "model AS (SELECT frame_id, " + ", ".join(
    f"arg_max(struct_pack(x := (x1+x2)//2, y := (y1+y2)//2), (confidence, -det_no)) FILTER (class_id = {i}) AS {s}_p"
    for s, i in BUTTON.items()
) + ", count(*) FILTER (class_id < 6) AS n_resources FROM det WHERE confidence >= 0.25 GROUP BY frame_id)"
TEXT = f"texts AS (SELECT frame_id, " + ", ".join(
    f"arg_max(struct_pack(x := (x1+x2)//2, y := (y1+y2)//2), det_no) FILTER (cid = {i}) AS {s}_p" for s, i in BUTTON.items()
) + f" FROM (SELECT *, {BASE_RULES} AS cid FROM ocr) WHERE cid IN (6,7,8,9,10) GROUP BY frame_id)"
PRED = """pred0 AS (SELECT f.frame_id, coalesce(n_resources, 0) AS n_resources, (coalesce(n_resources, 0) = 0 AND """ + " AND ".join(
    f"m.{s}_p IS NULL" for s in SIG
) + ") AS model_empty, " + ", ".join(f"m.{s}_p AS {s}_m, t.{s}_p AS {s}_t" for s in SIG) + """
  FROM frames f LEFT JOIN model m USING (frame_id) LEFT JOIN texts t USING (frame_id)),
pred1 AS (SELECT frame_id, n_resources, model_empty, """ + ", ".join(
    f"CASE WHEN model_empty THEN {s}_t ELSE {s}_m END AS {s}_p, {s}_m" for s in SIG
) + """ FROM pred0),
pred AS (SELECT *, CASE WHEN end_p IS NOT NULL OR next_p IS NOT NULL THEN '战斗中' WHEN attack_p IS NOT NULL AND end_p IS NULL THEN '村庄待机'
  WHEN search_p IS NOT NULL OR return_p IS NOT NULL THEN '搜索中' ELSE '未知/等待' END AS state FROM pred1)"""
EVAL = f"WITH {MODEL}, {TEXT}, {PRED}"
EVAL_VIEWS = "det ocr frames truth"


def predictions(spark, sf):
    return ev.pick_signals(
        src.frames(spark, sf), ev.model_signals(src.detections(spark, sf)), ev.text_signals(src.ocr_results(spark, sf))
    )


def flat(df, *extra):
    cols = [F.col(s)[a].alias(f"{s}_{a}") for s in SIG for a in ("x", "y")]
    return df.select("frame_id", *cols, *extra)


FLAT = ", ".join(f"{s}_p.{a} AS {s}_{a}" for s in SIG for a in ("x", "y"))


@query("ag5_best_box_signals", f"WITH {MODEL} SELECT frame_id, {FLAT}, CAST(n_resources AS BIGINT) AS n_resources FROM model", "det")
def best_box_signals(spark, sf):
    return flat(ev.model_signals(src.detections(spark, sf)), "n_resources")


@query("ag6_text_signals", f"WITH {TEXT} SELECT frame_id, {FLAT} FROM texts", "ocr")
def text_signals(spark, sf):
    t = ev.text_signals(src.ocr_results(spark, sf))
    some = F.coalesce(*[F.col(s) for s in SIG]).isNotNull()
    return flat(t.filter(some))


@query("so8_state_by_signal_rules", f"{EVAL} SELECT frame_id, model_empty, state FROM pred", EVAL_VIEWS)
def state_by_signal_rules(spark, sf):
    return predictions(spark, sf).select("frame_id", "model_empty", "state")


@query("ud5_rule_list", f"{EVAL} SELECT state, CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY state", EVAL_VIEWS)
def rule_list(spark, sf):
    return predictions(spark, sf).groupBy("state").agg(lb.count_rows("n"))


@query(
    "ag7_state_accuracy",
    f"""{EVAL} SELECT *, round(n_correct / n_scored, 4) AS accuracy FROM (SELECT
  CAST(count(*) FILTER (expected_state NOT LIKE '%捐兵%' AND expected_state = state) AS BIGINT) AS n_correct,
  CAST(count(*) FILTER (expected_state NOT LIKE '%捐兵%') AS BIGINT) AS n_scored,
  CAST(count(*) FILTER (expected_state LIKE '%捐兵%') AS BIGINT) AS n_donation FROM pred LEFT JOIN truth USING (frame_id))""",
    EVAL_VIEWS,
)
def state_accuracy(spark, sf):
    return ev.state_accuracy(predictions(spark, sf), src.ground_truth(spark, sf))


@query(
    "ag8_signal_recall",
    f"{EVAL} SELECT *, CASE WHEN n_expected > 0 THEN round(n_found / n_expected, 4) END AS recall FROM (" + " UNION ALL ".join(
        f"SELECT '{s}' AS signal, CAST(count(*) FILTER (exp_{s} AND {s}_p IS NOT NULL) AS BIGINT) AS n_found, CAST(count(*) FILTER (exp_{s}) AS BIGINT) AS n_expected FROM pred JOIN truth USING (frame_id)"
        for s in SIG
    ) + ")",
    EVAL_VIEWS,
)
def signal_recall(spark, sf):
    return ev.signal_recall(predictions(spark, sf), src.ground_truth(spark, sf))


@query(
    "ag9_resource_and_model_only",
    f"""{EVAL} SELECT CAST(count(*) FILTER (expected_state IN ('战斗中','搜索中','村庄待机')) AS BIGINT) AS n_scenes,
  CAST(count(*) FILTER (expected_state IN ('战斗中','搜索中','村庄待机') AND n_resources > 0) AS BIGINT) AS n_with_resources,
  CAST(count(*) AS BIGINT) AS n_frames, CAST(count(*) FILTER ({' OR '.join(f'{s}_m IS NOT NULL' for s in SIG)}) AS BIGINT) AS n_model_frames,
  CAST(sum({' + '.join(f'CAST({s}_m IS NOT NULL AS INT)' for s in SIG)}) AS BIGINT) AS n_model_signals,
  CAST(sum({' + '.join(f'CAST({s}_m IS NOT NULL AND exp_{s} AS INT)' for s in SIG)}) AS BIGINT) AS n_model_found
FROM pred LEFT JOIN truth USING (frame_id)""",
    EVAL_VIEWS,
)
def resource_and_model_only(spark, sf):
    j = ev.pick_signals(src.frames(spark, sf), ev.model_signals(src.detections(spark, sf)), None).join(
        src.ground_truth(spark, sf), "frame_id", "left"
    )
    scene = F.coalesce(F.col("expected_state").isin("战斗中", "搜索中", "村庄待机"), F.lit(False))
    seen = lambda s: F.col(s).isNotNull()
    some = F.coalesce(*[F.col(s) for s in SIG]).isNotNull()
    number = lambda conds: sum((c.cast("int") for c in conds), F.lit(0))
    return j.agg(
        F.count_if(scene).alias("n_scenes"),
        F.count_if(scene & (F.col("n_resources") > 0)).alias("n_with_resources"),
        lb.count_rows("n_frames"),
        F.count_if(some).alias("n_model_frames"),
        F.sum(number([seen(s) for s in SIG])).alias("n_model_signals"),
        F.sum(number([seen(s) & F.col("exp_" + s) for s in SIG])).alias("n_model_found"),
    )


@query(
    "sc9_ground_truth_scan",
    "SELECT expected_state, CAST(count(*) AS BIGINT) AS n, " + ", ".join(
        f"CAST(count(*) FILTER (exp_{s}) AS BIGINT) AS n_{s}" for s in SIG
    ) + " FROM (SELECT *, frame_id % 9 AS k FROM truth WHERE expected_state IS NOT NULL) GROUP BY expected_state",
    "truth",
)
def ground_truth_scan(spark, sf):
    t = src.ground_truth(spark, sf).filter("expected_state IS NOT NULL")
    signals = F.create_map(*[x for s in SIG for x in (F.lit(s), F.col("exp_" + s))])
    body = F.struct("expected_state", signals.alias("signals"))
    # one small map of maps per frame, as the label file stores it
    stored = t.select(F.to_json(F.create_map(F.concat(F.col("frame_id"), F.lit(".png")), body)).alias("json"))
    schema = "MAP<STRING, STRUCT<expected_state STRING, signals MAP<STRING, BOOLEAN>>>"
    files = stored.select(F.explode(F.from_json("json", schema)).alias("file", "v"))
    rows = files.select("file", "v.expected_state", F.explode("v.signals").alias("signal", "want"))
    return rows.groupBy("expected_state").agg(
        F.count_if(F.col("signal") == SIG[0]).alias("n"),
        *[F.count_if((F.col("signal") == s) & F.col("want")).alias("n_" + s) for s in SIG],
    )


@query(
    "jo14_prediction_truth_join",
    f"""{EVAL} SELECT frame_id, coalesce(expected_state, '') AS expected_state, state, coalesce(expected_state = state, false) AS state_match FROM pred LEFT JOIN truth USING (frame_id)""",
    EVAL_VIEWS,
)
def prediction_truth_join(spark, sf):
    j = predictions(spark, sf).join(src.ground_truth(spark, sf), "frame_id", "left")
    return j.select(
        "frame_id", F.coalesce("expected_state", F.lit("")).alias("expected_state"), "state",
        F.coalesce(F.col("expected_state") == F.col("state"), F.lit(False)).alias("state_match"),
    )


@query(
    "ag18_accuracy_and_error",
    """SELECT round(avg(CAST(y = p AS INT)), 6) AS accuracy, round(avg(abs(y - p)), 6) AS mae, round(avg((y-p)*(y-p)), 6) AS mean_loss, CAST(count(*) AS BIGINT) AS n
FROM (SELECT l.quality AS y, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id))""",
)
def accuracy_and_error(spark, sf):
    d = src.table(spark, sf, "documents").selectExpr("doc_id", "CAST(n_chars >= 1000 AS INT) AS p")
    j = src.table(spark, sf, "labels").selectExpr("doc_id", "quality AS y").join(d, "doc_id")
    err = F.abs(F.col("y") - F.col("p"))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return j.agg(
        zero(F.avg((F.col("y") == F.col("p")).cast("int"))).alias("accuracy"), zero(F.avg(err)).alias("mae"),
        zero(F.avg(err * err)).alias("mean_loss"), lb.count_rows("n"),
    )


@query(
    "ag20_timing_stats",
    """SELECT event_type AS target, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high,
  round(stddev_samp(value), 4) AS stddev FROM events GROUP BY event_type""",
)
def timing_stats(spark, sf):
    return src.table(spark, sf, "events").groupBy(F.col("event_type").alias("target")).agg(
        lb.count_rows("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.round(F.stddev_samp("value"), 4).alias("stddev"),
    )


# --- recognised numbers -------------------------------------------------------------------

BAR = f"""bar AS (SELECT * FROM (SELECT frame_id, det_no % 10 = 0 AS nobox, CASE WHEN det_no % 10 = 0 THEN 0 ELSE (x1+x2)/2 END AS cx,
  CASE WHEN det_no % 10 = 0 THEN 0 ELSE (y1+y2)/2 END AS cy, y2, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM ocr)
  WHERE digits <> '' AND (nobox OR y2 <= {H} * 0.16::DOUBLE))"""


def bar_texts(spark, sf):
    return src.ocr_results(spark, sf).withColumn("bbox", F.when(F.col("det_no") % 10 != 0, F.col("bbox")))


@query("fi8_top_bar_numbers", f"WITH {BAR} SELECT frame_id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, TRY_CAST(digits AS BIGINT) AS value FROM bar WHERE TRY_CAST(digits AS BIGINT) IS NOT NULL", "ocr")
def top_bar_numbers(spark, sf):
    return ev.top_bar(bar_texts(spark, sf), H)


STORE = {"gold": 900, "elixir": 700, "dark_elixir": 500}
STATUS = f"""WITH {BAR}, r AS (SELECT frame_id, TRY_CAST(digits AS BIGINT) AS v, row_number() OVER (PARTITION BY frame_id ORDER BY cx, cy, TRY_CAST(digits AS BIGINT)) AS rn FROM bar WHERE TRY_CAST(digits AS BIGINT) IS NOT NULL),
w AS (SELECT f.frame_id, count(rn) FILTER (rn <= 3) AS detected, coalesce(max(v) FILTER (rn = 1), 0) AS gold, coalesce(max(v) FILTER (rn = 2), 0) AS elixir,
  coalesce(max(v) FILTER (rn = 3), 0) AS dark_elixir FROM frames f LEFT JOIN r USING (frame_id) GROUP BY 1),
st AS (SELECT frame_id, CAST(detected AS BIGINT) AS detected, gold, elixir, dark_elixir, detected >= 1 AND gold >= 900 AS gold_full,
  detected >= 2 AND elixir >= 700 AS elixir_full, detected >= 3 AND dark_elixir >= 500 AS dark_elixir_full FROM w)"""


@query("tk5_left_to_right_numbers", f"{STATUS} SELECT frame_id, detected, gold, elixir, dark_elixir FROM st", "ocr frames")
def left_to_right_numbers(spark, sf):
    s = ev.resource_status(src.frames(spark, sf), ev.top_bar(bar_texts(spark, sf), H), STORE)
    return s.select("frame_id", "detected", "gold", "elixir", "dark_elixir")


@query(
    "fn13_resource_full_flags",
    f"""{STATUS} SELECT gold_full, elixir_full, dark_elixir_full, all_full, CAST(count(*) AS BIGINT) AS n FROM (SELECT *,
  detected >= 2 AND gold_full AND elixir_full AND (detected < 3 OR dark_elixir_full) AS all_full FROM st) GROUP BY ALL""",
    "ocr frames",
)
def resource_full_flags(spark, sf):
    s = ev.resource_status(src.frames(spark, sf), ev.top_bar(bar_texts(spark, sf), H), STORE)
    return s.groupBy("gold_full", "elixir_full", "dark_elixir_full", "all_full").agg(lb.count_rows("n"))


@query(
    "pr19_spoken_resources",
    """WITH t AS (SELECT frame_id, det_no, regexp_extract(replace(replace(text, ',', ''), ' ', ''), '([0-9]+)', 1) AS d,
  CASE WHEN contains(lower(text), 'gold') OR contains(text, '金币') THEN 'gold' WHEN contains(lower(text), 'elixir') OR contains(text, '圣水') THEN 'elixir'
    WHEN contains(lower(text), 'dark') OR contains(text, '黑油') THEN 'dark' END AS k FROM ocr),
h AS (SELECT frame_id, det_no, TRY_CAST(d AS BIGINT) AS v, k FROM t WHERE k IS NOT NULL AND d <> '')
SELECT f.frame_id, coalesce(arg_max(v, det_no) FILTER (k = 'gold'), 0) AS gold, coalesce(arg_max(v, det_no) FILTER (k = 'elixir'), 0) AS elixir,
  coalesce(arg_max(v, det_no) FILTER (k = 'dark'), 0) AS dark_elixir FROM frames f LEFT JOIN h USING (frame_id) GROUP BY f.frame_id""",
    "ocr frames",
)
def spoken_resources(spark, sf):
    return ev.spoken_resources(src.frames(spark, sf), src.ocr_results(spark, sf))


ORDER = "CASE class_id " + " ".join(
    f"WHEN {vocab.CLASSES.index(n)} THEN {i}" for i, n in enumerate(vocab.BUILDING_RESOURCE)
) + " END"


SPOKEN = """t AS (SELECT frame_id, det_no, regexp_extract(replace(replace(text, ',', ''), ' ', ''), '([0-9]+)', 1) AS d,
  CASE WHEN contains(lower(text), 'gold') OR contains(text, '金币') THEN 'gold' WHEN contains(lower(text), 'elixir') OR contains(text, '圣水') THEN 'elixir'
    WHEN contains(lower(text), 'dark') OR contains(text, '黑油') THEN 'dark' END AS k FROM ocr),
h AS (SELECT frame_id, det_no, TRY_CAST(d AS BIGINT) AS v, k FROM t WHERE k IS NOT NULL AND d <> ''),
sp AS (SELECT f.frame_id, coalesce(arg_max(v, det_no) FILTER (k = 'gold'), 0) AS said_gold, coalesce(arg_max(v, det_no) FILTER (k = 'elixir'), 0) AS said_elixir,
  coalesce(arg_max(v, det_no) FILTER (k = 'dark'), 0) AS said_dark FROM frames f LEFT JOIN h USING (frame_id) GROUP BY f.frame_id)"""


@query(
    "pr23_frame_signals",
    f"""{STATUS}, {SPOKEN}, k AS (SELECT frame_id, det_no, class_id, (x1+x2)//2 AS x, (y1+y2)//2 AS y, {ORDER} AS p FROM det),
s AS (SELECT f.frame_id, arg_min(x, det_no) FILTER (class_id = 6) AS attack_x, arg_min(y, det_no) FILTER (class_id = 10) AS end_y,
  arg_min(x, det_no) FILTER (class_id = 12) AS list_x, arg_min(x, det_no) FILTER (class_id = 16) AS troops_x,
  arg_min(class_id, (p, det_no)) FILTER (p IS NOT NULL) AS target_class, arg_min(x, (p, det_no)) FILTER (p IS NOT NULL) AS target_x,
  CAST(count(p) AS BIGINT) AS n_targets, CASE WHEN count(*) FILTER (class_id = 13) > 0 THEN count(*) FILTER (class_id = 13) > 1 END AS more_requests
FROM frames f LEFT JOIN k ON f.frame_id = k.frame_id AND x > 0 AND y > 0 GROUP BY f.frame_id),
kr AS (SELECT frame_id, CASE WHEN detected > 0 THEN [gold, elixir, dark_elixir] WHEN greatest(said_gold, said_elixir, said_dark) > 0 THEN [said_gold, said_elixir, said_dark] END AS a FROM st JOIN sp USING (frame_id))
SELECT s.*, CAST(a[1] AS BIGINT) AS gold, CAST(a[2] AS BIGINT) AS elixir, CAST(a[3] AS BIGINT) AS dark_elixir FROM s JOIN kr USING (frame_id)""",
    "det ocr frames",
)
def frame_signals(spark, sf):
    frames = src.frames(spark, sf)
    status = ev.resource_status(frames, ev.top_bar(bar_texts(spark, sf), H), STORE)
    resources = ev.known_resources(status, ev.spoken_resources(frames, src.ocr_results(spark, sf)))
    s = ev.frame_signals(frames, src.detections(spark, sf), resources)
    return s.selectExpr(
        "frame_id", "attack.x AS attack_x", "end.y AS end_y", "list.x AS list_x", "troops.x AS troops_x",
        "target.class_id AS target_class", "target.x AS target_x", "n_targets", "more_requests", "resources.gold AS gold", "resources.elixir AS elixir", "resources.dark_elixir AS dark_elixir",
    )


ICON = "CASE WHEN class_id = 7 THEN CASE det_no % 4 WHEN 0 THEN '金币采集图标' WHEN 1 THEN '圣水采集图标' WHEN 2 THEN '黑油采集图标' ELSE type END ELSE type END"
BUILDINGS = case("type", {n: i for i, n in enumerate(vocab.BUILDING_RESOURCE)})
POINT_RESOURCE = case("type", {**vocab.BUILDING_RESOURCE, **{i: r for r, i in vocab.COLLECT_ICONS.items()}})


@query(
    "pr23_signal_points",
    f"""WITH n AS (SELECT frame_id, det_no, {ICON} AS type, (x1+x2)//2 AS x, (y1+y2)//2 AS y FROM named),
k AS (SELECT *, CASE WHEN {BUILDINGS} IS NOT NULL THEN 'target' WHEN ends_with(type, '采集图标') THEN 'icon' WHEN type = '请求条目' THEN 'request' END AS kind, coalesce({BUILDINGS}, 0) AS p FROM n)
SELECT frame_id, kind, CAST(row_number() OVER (PARTITION BY frame_id, kind ORDER BY p, det_no) AS BIGINT) AS place, type AS name, {POINT_RESOURCE} AS resource, x, y FROM k WHERE kind IS NOT NULL AND x > 0 AND y > 0""",
    "named",
)
def signal_points(spark, sf):
    return ev.signal_points(src.named_detections(spark, sf).withColumn("type", F.expr(ICON)))


@query(
    "pr20_state_detections",
    """SELECT frame_id, det_no, type, (x1+x2)//2 AS x, (y1+y2)//2 AS y, confidence FROM (SELECT frame_id, det_no, type, confidence, y1, y2,
  CASE WHEN det_no % 12 = 0 THEN 0 ELSE x1 END AS x1, CASE WHEN det_no % 12 = 0 THEN 0 ELSE x2 END AS x2 FROM named) WHERE (x1+x2)//2 > 0 AND (y1+y2)//2 > 0""",
    "named",
)
def state_detections(spark, sf):
    d = src.named_detections(spark, sf)
    gone = F.col("det_no") % 12 == 0
    d = d.withColumns({c: F.when(gone, 0).otherwise(F.col(c)) for c in ("x1", "x2")})
    return d.selectExpr(
        "frame_id", "det_no", "type", "CAST((x1 + x2) div 2 AS INT) AS x", "CAST((y1 + y2) div 2 AS INT) AS y", "confidence"
    ).filter("x > 0 AND y > 0")


# --- routing ----------------------------------------------------------------------------------

ROUTE = """per AS (SELECT frame_id, count(*) AS n, CAST(sum(CAST(round(confidence * 1000000) AS BIGINT)) AS BIGINT) AS s, bool_or(class_id < 6) AS has_key FROM det GROUP BY 1),
routed AS (SELECT f.frame_id, f.ts, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN ['本地模型未检出任何建筑'] ELSE list_filter([
    CASE WHEN s < n * 500000 THEN concat('平均置信度 ', printf('%.2f', s / (n * 1000000)), ' < 阈值 0.50') END,
    CASE WHEN NOT has_key THEN '未检出场景关键建筑' END], lambda x: x IS NOT NULL) END AS reasons FROM frames f LEFT JOIN per USING (frame_id)),
log AS (SELECT frame_id, ts, n, frame_id % 25 = 0 AS forced, CASE WHEN frame_id % 25 = 0 THEN [] ELSE reasons END AS reasons,
  CASE WHEN frame_id % 25 = 0 THEN 'llm' WHEN len(reasons) > 0 AND frame_id % 10 = 3 THEN 'local_no_llm' WHEN len(reasons) > 0 THEN 'llm' ELSE 'local' END AS route,
  500 + 20 * n AS prompt_tokens, 7 + 30 * n AS completion_tokens FROM routed)"""


def route_log(spark, sf):
    routed = rt.route_reasons(
        src.frames(spark, sf).select("frame_id", "ts"), src.detections(spark, sf), F.col("class_id") < 6
    )
    log = rt.route_log(routed, F.col("frame_id") % 25 == 0, F.col("frame_id") % 10 == 3)
    return log.withColumns({"prompt_tokens": 500 + 20 * F.col("n"), "completion_tokens": 7 + 30 * F.col("n")})


@query("ag11_route_reasons", f"WITH {ROUTE} SELECT frame_id, reasons, len(reasons) > 0 AS needs_teacher FROM routed", "det frames")
def route_reasons(spark, sf):
    r = rt.route_reasons(src.frames(spark, sf).select("frame_id"), src.detections(spark, sf), F.col("class_id") < 6)
    return r.select("frame_id", "reasons", "needs_teacher")


@query(
    "ag10_route_totals",
    f"""WITH {ROUTE} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (route <> 'llm') AS BIGINT) AS local, CAST(count(*) FILTER (route = 'llm') AS BIGINT) AS llm,
  CAST(sum(prompt_tokens) FILTER (route = 'llm') AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) FILTER (route = 'llm') AS BIGINT) AS completion_tokens,
  round(count(*) FILTER (route = 'llm') / count(*), 4) AS llm_ratio FROM log""",
    "det frames",
)
def route_totals(spark, sf):
    return rt.totals(route_log(spark, sf))


@query(
    "tk4_reason_histogram",
    f"WITH {ROUTE} SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(reasons) AS reason FROM log WHERE route = 'llm') GROUP BY reason ORDER BY n DESC, reason",
    "det frames",
)
def reason_histogram(spark, sf):
    return rt.reason_histogram(route_log(spark, sf))


@query(
    "sk3_newest_samples_kept",
    f"WITH {ROUTE} SELECT frame_id, ts FROM log WHERE route = 'llm' ORDER BY ts DESC, frame_id DESC LIMIT 500",
    "det frames",
)
def newest_samples_kept(spark, sf):
    return route_log(spark, sf).filter("route = 'llm'").orderBy(F.desc("ts"), F.desc("frame_id")).limit(500).select("frame_id", "ts")


@query(
    "st7_route_counters_by_window",
    f"""WITH {ROUTE} SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS start, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (route <> 'llm') AS BIGINT) AS local,
  CAST(count(*) FILTER (route = 'llm') AS BIGINT) AS llm, CAST(coalesce(sum(prompt_tokens) FILTER (route = 'llm'), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(completion_tokens) FILTER (route = 'llm'), 0) AS BIGINT) AS completion_tokens, round(count(*) FILTER (route = 'llm') / count(*), 4) AS llm_ratio FROM log GROUP BY 1""",
    "det frames",
)
def route_counters_by_window(spark, sf):
    log = route_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    t = rt.totals(log, F.window("ts", "30 days"))
    return t.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *[c for c in t.columns if c != "window"])
