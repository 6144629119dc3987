"""Queries on detections, recognised text and label tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.functions import text as tx
from sightlog.operators import boxes as bx
from sightlog.operators import labels as lb
from sightlog.operators import splits
from sightlog.plans.registry import query
from sightlog.plans.views import case
from sightlog.sources import tables as src

W, H = src.CANVAS
NAME_ID = {n: i for i, n in enumerate(vocab.CLASSES)}
FARM_ID = {n: i for i, n in enumerate(vocab.FARM_CLASSES)}
PW = case("type", {k: v[0] for k, v in vocab.PRIOR_BOX.items()}, "0.1")
PH = case("type", {k: v[1] for k, v in vocab.PRIOR_BOX.items()}, "0.1")
FPW = case("type", {k: v[0] for k, v in vocab.FARM_PRIOR_BOX.items()}, "0.1")
FPH = case("type", {k: v[1] for k, v in vocab.FARM_PRIOR_BOX.items()}, "0.1")
D = "CAST({} AS DOUBLE)".format


def rounded(struct: str, *fields: str, digits: int = 6):
    return [g.round_half_even(F.col(struct)[f], digits).alias(f) for f in fields]


BOX = ("cx", "cy", "bw", "bh")
BASE_RULES = "CASE " + " ".join(
    f"WHEN contains(text, '{k}') THEN {NAME_ID[n]}" for k, n in vocab.BUTTON_TEXT
) + " END"
ALL_RULES = "CASE " + " ".join(
    f"WHEN contains(text, '{k}') THEN {NAME_ID[n]}" for k, n in vocab.BUTTON_TEXT + vocab.EXTRA_BUTTON_TEXT
) + " END"


# --- projections -------------------------------------------------------------------


@query("pr1_box_centre", "SELECT frame_id, det_no, (x1+x2)//2 AS cx, (y1+y2)//2 AS cy FROM det", "det")
def box_centre(spark, sf):
    d = src.detections(spark, sf)
    return d.select(
        "frame_id", "det_no",
        g.centre(F.col("x1"), F.col("x2")).alias("cx"), g.centre(F.col("y1"), F.col("y2")).alias("cy"),
    )


@query(
    "pr2_normalised_box",
    f"""SELECT frame_id, det_no, class_id, r6((x1+x2)/2/{W}) AS cx, r6((y1+y2)/2/{H}) AS cy,
  r6((x2-x1)/{W}) AS bw, r6((y2-y1)/{H}) AS bh FROM det WHERE x2 > x1 AND y2 > y1""",
    "det",
)
def normalised_box(spark, sf):
    d = src.detections(spark, sf).filter("x2 > x1 AND y2 > y1")
    box = g.normalised(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(W), F.lit(H))
    return d.withColumn("b", box).select("frame_id", "det_no", "class_id", *rounded("b", *BOX))


NORM = f"""SELECT frame_id, det_no, class_id, (x1+x2)/2/{W} AS cx, (y1+y2)/2/{H} AS cy,
  (x2-x1)/{W} AS w0, (y2-y1)/{H} AS h0 FROM det"""
CLAMPED = """SELECT frame_id, det_no, class_id, least(greatest(cx, bw/2), 1.0::DOUBLE-bw/2) AS cx,
  least(greatest(cy, bh/2), 1.0::DOUBLE-bh/2) AS cy, bw, bh FROM (SELECT *, least(greatest(w0, 1e-6), 1.0::DOUBLE) AS bw,
  least(greatest(h0, 1e-6), 1.0::DOUBLE) AS bh FROM norm)"""


@query(
    "pr3_clamped_line",
    f"""WITH norm AS ({NORM}), cl AS ({CLAMPED})
SELECT frame_id, det_no, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, bw, bh) AS line
FROM cl""",
    "det",
)
def clamped_line(spark, sf):
    d = src.detections(spark, sf)
    n = g.normalised(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(W), F.lit(H))
    d = g.add_clamped(d.withColumn("n", n), "b", *[F.col("n")[f] for f in BOX])
    return d.select("frame_id", "det_no", g.box_line(F.col("class_id"), F.col("b")).alias("line"))


def stored_lines(spark, sf):
    """Label text as stored: not clamped, some lines with four tokens, some blank."""
    d = src.detections(spark, sf)
    n = g.normalised(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(W), F.lit(H))
    full = g.box_line(F.col("class_id"), F.col("n"))
    return d.withColumn("n", n).select(
        "frame_id", "det_no", F.lit(W).alias("w"), F.lit(H).alias("h"),
        F.when(F.col("det_no") % 13 == 0, F.regexp_extract(full, r"^(\S+ \S+ \S+ \S+)", 1))
        .when(F.col("det_no") % 17 == 0, F.lit("  "))
        .otherwise(full).alias("line"),
    )


STORED = f"""stored AS (SELECT frame_id, det_no, class_id,
  CASE WHEN det_no % 13 = 0 THEN printf('%d %.6f %.6f %.6f', class_id, cx, cy, w0)
    WHEN det_no % 17 = 0 THEN '  '
    ELSE printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w0, h0) END AS line
  FROM ({NORM}))"""


@query(
    "pr4_clamp_repair",
    f"""WITH {STORED}, norm AS (SELECT frame_id, det_no, line, string_split(trim(line), ' ') AS t FROM stored WHERE trim(line) <> ''),
p AS (SELECT frame_id, det_no, line, len(t) = 5 AS five, t[1] AS c, TRY_CAST(t[2] AS DOUBLE) AS cx, TRY_CAST(t[3] AS DOUBLE) AS cy,
  least(greatest(TRY_CAST(t[4] AS DOUBLE), 1e-6), 1.0::DOUBLE) AS bw, least(greatest(TRY_CAST(t[5] AS DOUBLE), 1e-6), 1.0::DOUBLE) AS bh FROM norm),
f AS (SELECT frame_id, CASE WHEN five THEN printf('%s %.6f %.6f %.6f %.6f', c, least(greatest(cx, bw/2), 1.0::DOUBLE-bw/2),
  least(greatest(cy, bh/2), 1.0::DOUBLE-bh/2), bw, bh) ELSE line END AS fixed, line FROM p)
SELECT frame_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (fixed <> trim(line)) AS BIGINT) AS n_changed,
  bool_or(fixed <> trim(line)) AS changed FROM f GROUP BY frame_id""",
    "det",
)
def clamp_repair(spark, sf):
    fixed = bx.clamp_label_lines(stored_lines(spark, sf))
    return fixed.groupBy("frame_id").agg(
        lb.count_rows("n_lines"), F.count_if("changed").alias("n_changed"), F.bool_or("changed").alias("changed")
    )


@query(
    "pr5_clamped_pixel_box",
    f"""WITH s AS (SELECT frame_id, det_no, {D('CASE WHEN det_no % 7 = 0 THEN x2 ELSE x1 - 40 END')} AS x1,
  {D('CASE WHEN det_no % 7 = 0 THEN x1 ELSE x2 END')} AS x2, {D('y1 - 30')} AS y1, {D('y2 + 60')} AS y2 FROM det),
l AS (SELECT *, greatest(0, least(x1, x2)) AS bx1, greatest(0, least(y1, y2)) AS by1 FROM s),
c AS (SELECT frame_id, det_no, bx1, by1, least({W}, greatest(bx1, x2)) AS bx2, least({H}, greatest(by1, y2)) AS by2 FROM l)
SELECT * FROM c WHERE bx2 > bx1 AND by2 > by1""",
    "det",
)
def clamped_pixel_box(spark, sf):
    d = src.detections(spark, sf)
    swap = F.col("det_no") % 7 == 0
    d = g.add_clamped_to_image(
        d, "b", F.when(swap, F.col("x2")).otherwise(F.col("x1") - 40).cast("double"), (F.col("y1") - 30).cast("double"),
        F.when(swap, F.col("x1")).otherwise(F.col("x2")).cast("double"), (F.col("y2") + 60).cast("double"),
        F.lit(W), F.lit(H),
    )
    return (
        d
        .select("frame_id", "det_no", *[F.col("b")[c].alias("b" + c) for c in ("x1", "y1", "x2", "y2")])
    )


def teacher_objects(spark, sf):
    """Missed objects of a teacher: fractions, old-canvas pixels, points, or nothing usable."""
    d = src.named_detections(spark, sf)
    dbl = lambda *c: F.array(*[F.expr(x).cast("double") for x in c])
    m = F.col("det_no") % 5
    return d.select(
        "frame_id", "det_no", "class_id", "type", "confidence",
        F.when(m == 0, dbl(f"least(1, x1 / {W})", f"least(1, y1 / {H})", f"least(1, x2 / {W})", f"least(1, y2 / {H})"))
        .when(m == 1, dbl("x1 - 30", "y1", "x2", "y2 + 300")).when(m == 2, dbl("x1", "y1")).alias("bbox"),
        F.when(m == 2, dbl("x1 + 10", "y1 * 2")).when(m == 3, dbl(f"x1 / {W}", f"y1 / {H}")).alias("coords"),
    )


OBJ = f"""obj AS (SELECT frame_id, det_no, class_id, type, confidence, det_no % 5 AS m,
  CASE det_no % 5 WHEN 0 THEN [{D(f'least(1, x1 / {W})')}, {D(f'least(1, y1 / {H})')}, {D(f'least(1, x2 / {W})')}, {D(f'least(1, y2 / {H})')}]
    WHEN 1 THEN [{D('x1 - 30')}, {D('y1')}, {D('x2')}, {D('y2 + 300')}] END AS b,
  CASE det_no % 5 WHEN 2 THEN [{D('x1 + 10')}, {D('y1 * 2')}] WHEN 3 THEN [{D(f'x1 / {W}')}, {D(f'y1 / {H}')}] END AS p FROM named)"""


@query(
    "pr6_legacy_canvas_box",
    f"""WITH {OBJ},
v AS (SELECT frame_id, det_no, CASE
    WHEN m = 0 THEN [b[1]*{W}, b[2]*{H}, b[3]*{W}, b[4]*{H}]
    WHEN m = 1 AND list_min(b) >= 0 AND list_max(b) <= 1 THEN [b[1]*{W}, b[2]*{H}, b[3]*{W}, b[4]*{H}]
    WHEN m = 1 THEN [b[1]*{W}/{D(1280)}, b[2]*{H}/{D(960)}, b[3]*{W}/{D(1280)}, b[4]*{H}/{D(960)}]
    WHEN p IS NOT NULL THEN (SELECT [cx-{PW}*{W}/2, cy-{PH}*{H}/2, cx+{PW}*{W}/2, cy+{PH}*{H}/2] FROM (SELECT
      CASE WHEN list_max(p) <= 1 THEN p[1]*{W} ELSE p[1]*{W}/{D(1280)} END AS cx,
      CASE WHEN list_max(p) <= 1 THEN p[2]*{H} ELSE p[2]*{H}/{D(960)} END AS cy)) END AS v FROM obj),
l AS (SELECT frame_id, det_no, v, greatest(0, least(v[1], v[3])) AS bx1, greatest(0, least(v[2], v[4])) AS by1 FROM v WHERE v IS NOT NULL),
c AS (SELECT frame_id, det_no, bx1, by1, least({W}, greatest(bx1, v[3])) AS bx2, least({H}, greatest(by1, v[4])) AS by2 FROM l)
SELECT frame_id, det_no, round(bx1,4) AS bx1, round(by1,4) AS by1, round(bx2,4) AS bx2, round(by2,4) AS by2
FROM c WHERE bx2 > bx1 AND by2 > by1""",
    "named",
)
def legacy_canvas_box(spark, sf):
    o = teacher_objects(spark, sf)
    return (
        bx.add_legacy_box(o, "b", F.lit(W), F.lit(H))
        .select("frame_id", "det_no", *[F.round(F.col("b")[c], 4).alias("b" + c) for c in ("x1", "y1", "x2", "y2")])
    )


TBOX = f"""v AS (SELECT frame_id, det_no, class_id, type, confidence, p,
    least(greatest(b[1],0),{W}) AS x1, least(greatest(b[2],0),{H}) AS y1, least(greatest(b[3],0),{W}) AS x2, least(greatest(b[4],0),{H}) AS y2 FROM obj),
tb AS (SELECT frame_id, det_no, class_id, type, confidence,
  CASE WHEN x2>x1 AND y2>y1 AND x1<{W} AND y1<{H} THEN [(x1+x2)/2/{W}, (y1+y2)/2/{H}, least((x2-x1)/{W},1), least((y2-y1)/{H},1)]
    WHEN p[1]>=0 AND p[1]<{W} AND p[2]>=0 AND p[2]<{H} THEN [p[1]/{W}, p[2]/{H}, {PW}, {PH}] END AS o FROM v)"""


@query(
    "pr7_teacher_box",
    f"""WITH {OBJ}, {TBOX}
SELECT frame_id, det_no, r6(o[1]) AS cx, r6(o[2]) AS cy, r6(o[3]) AS bw, r6(o[4]) AS bh
FROM tb WHERE o IS NOT NULL""",
    "named",
)
def teacher_box(spark, sf):
    o = teacher_objects(spark, sf)
    return bx.add_teacher_box(o, "b", F.lit(W), F.lit(H)).select("frame_id", "det_no", *rounded("b", *BOX))


def logical_objects(spark, sf):
    return src.named_detections(spark, sf).select(
        "frame_id", "det_no", "type", "confidence", F.lit(1920).alias("w"), F.lit(1080).alias("h"),
        F.when(F.col("det_no") % 10 == 0, 0).otherwise(F.col("x2")).alias("x"), F.col("y2").alias("y"),
    )


LOGICAL = f"""o AS (SELECT frame_id, det_no, type, confidence, CASE WHEN det_no % 10 = 0 THEN 0 ELSE x2 END AS x, y2 AS y FROM named),
q AS (SELECT frame_id, det_no, type, x/1280*1920 AS cx, y/720*1080 AS cy, {FPW}*1.0::DOUBLE*1920 AS bw, {FPH}*1.0::DOUBLE*1080 AS bh
  FROM o WHERE type IN ({', '.join(repr(n) for n in vocab.FARM_CLASSES)}) AND confidence >= 0.5 AND x > 0 AND y > 0),
r AS (SELECT frame_id, det_no, type, greatest(0, cx-bw/2) AS x1, greatest(0, cy-bh/2) AS y1, least(1920, cx+bw/2) AS x2, least(1080, cy+bh/2) AS y2
  FROM q WHERE cx > 0 AND cx < 1920 AND cy > 0 AND cy < 1080),
lg AS (SELECT * FROM r WHERE x2 > x1 AND y2 > y1)"""


@query(
    "pr8_logical_canvas_box",
    f"""WITH {LOGICAL} SELECT frame_id, det_no, {case('type', FARM_ID)} AS farm_id, r6((x1+x2)/2/1920) AS cx, r6((y1+y2)/2/1080) AS cy,
  r6((x2-x1)/1920) AS bw, r6((y2-y1)/1080) AS bh FROM lg""",
    "named",
)
def logical_canvas_box(spark, sf):
    b = bx.logical_point_boxes(logical_objects(spark, sf))
    return b.select("frame_id", "det_no", "farm_id", *rounded("box", *BOX))


def ocr_sql(rules: str, prior: bool = False) -> str:
    if prior:
        pw = case("class_id", {i: vocab.PRIOR_BOX[n][0] for i, n in enumerate(vocab.CLASSES)})
        box = f"""SELECT frame_id, det_no, class_id, confidence, greatest(0, cx-bw/2) AS x1, greatest(0, cy-bh/2) AS y1,
          least({W}, cx+bw/2) AS x2, least({H}, cy+bh/2) AS y2 FROM (SELECT *, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy,
          greatest((x2-x1)*2.2::DOUBLE, {pw}*{W}) AS bw, (y2-y1)*1.4::DOUBLE AS bh FROM hit)"""
    else:
        box = f"""SELECT frame_id, det_no, class_id, confidence, greatest(0, x1-12) AS x1, greatest(0, y1-12) AS y1,
          least({W}, x2+12) AS x2, least({H}, y2+12) AS y2 FROM hit"""
    return f"""hit AS (SELECT * FROM (SELECT *, {rules} AS class_id FROM ocr WHERE confidence >= 0.5) WHERE class_id IS NOT NULL),
ob AS (SELECT * FROM ({box}) WHERE x2 > x1 AND y2 > y1)"""


OCR_OUT = f"""SELECT frame_id, det_no, class_id, r6((x1+x2)/2/{W}) AS cx, r6((y1+y2)/2/{H}) AS cy,
  r6((x2-x1)/{W}) AS bw, r6((y2-y1)/{H}) AS bh FROM ob"""


@query("pr9_button_box_padded", f"WITH {ocr_sql(BASE_RULES)} {OCR_OUT}", "ocr")
def button_box_padded(spark, sf):
    b = bx.ocr_boxes(src.ocr_results(spark, sf), W, H)
    return b.select("frame_id", "det_no", "class_id", *rounded("box", *BOX))


@query("pr9_button_box_prior", f"WITH {ocr_sql(BASE_RULES, True)} {OCR_OUT}", "ocr")
def button_box_prior(spark, sf):
    b = bx.ocr_boxes(src.ocr_results(spark, sf), W, H, prior_mode=True)
    return b.select("frame_id", "det_no", "class_id", *rounded("box", *BOX))


@query("pr10_extended_text_box", f"WITH {ocr_sql(ALL_RULES)} {OCR_OUT}", "ocr")
def extended_text_box(spark, sf):
    b = bx.ocr_boxes(src.ocr_results(spark, sf), W, H, extended=True)
    return b.select("frame_id", "det_no", "class_id", *rounded("box", *BOX))


# --- scans of label text --------------------------------------------------------------


def scan_sql(cast: str) -> str:
    c = lambda e: cast.format(e)
    return f"""WITH {STORED}, t AS (SELECT frame_id, det_no, string_split(trim(line), ' ') AS t FROM stored),
p AS (SELECT frame_id, det_no, CAST(t[1] AS INT) AS class_id, CAST(t[2] AS DOUBLE) AS cx, CAST(t[3] AS DOUBLE) AS cy, CAST(t[4] AS DOUBLE) AS bw,
  CAST(t[5] AS DOUBLE) AS bh FROM t WHERE len(t) = 5)
SELECT frame_id, det_no, class_id, {c(f'(cx-bw/2)*{W}')} AS x1, {c(f'(cy-bh/2)*{H}')} AS y1, {c(f'(cx+bw/2)*{W}')} AS x2, {c(f'(cy+bh/2)*{H}')} AS y2 FROM p"""


@query("sc2_label_scan_truncating", scan_sql("CAST(trunc({}) AS INT)"), "det")
def label_scan_truncating(spark, sf):
    return bx.parse_label_lines(stored_lines(spark, sf)).drop("w", "h")


@query("sc3_label_scan_rounding", scan_sql("CAST(round_even({}, 0) AS INT)"), "det")
def label_scan_rounding(spark, sf):
    return bx.parse_label_lines(stored_lines(spark, sf), "round").drop("w", "h")


@query(
    "sc4_label_map_load",
    """SELECT d.class_id, d.class_name, CAST(count(*) AS BIGINT) AS n_boxes FROM det JOIN class_dim d USING (class_id)
GROUP BY ALL""",
    "det class_dim",
)
def label_map_load(spark, sf):
    d = src.detections(spark, sf).groupBy("class_id").agg(lb.count_rows("n_boxes"))
    # the stored map has text keys, one JSON object for the whole data set
    names = F.to_json(F.map_from_entries(F.collect_set(F.struct(F.col("class_id").cast("string"), "class_name"))))
    stored = d.withColumn("class_name", vocab.class_name(F.col("class_id"))).agg(names.alias("json"))
    loaded = stored.select(F.explode(F.from_json("json", "MAP<STRING,STRING>")).alias("k", "class_name")).select(
        F.col("k").cast("int").alias("class_id"), "class_name"
    )
    return d.join(F.broadcast(loaded), "class_id")


# --- filters and rules on text ----------------------------------------------------------


@query("fn2_button_text", f"SELECT text, CAST(count(*) AS BIGINT) AS n, {BASE_RULES} AS class_id FROM ocr GROUP BY text", "ocr")
def button_text(spark, sf):
    t = src.ocr_results(spark, sf).groupBy("text").agg(lb.count_rows("n"))
    return t.withColumn("class_id", tx.button_class(F.col("text")))


@query("fn3_extended_button_text", f"SELECT text, CAST(count(*) AS BIGINT) AS n, {ALL_RULES} AS class_id FROM ocr GROUP BY text", "ocr")
def extended_button_text(spark, sf):
    t = src.ocr_results(spark, sf).groupBy("text").agg(lb.count_rows("n"))
    return t.withColumn("class_id", tx.any_button_class(F.col("text")))


@query("fi1_confidence_floor", "SELECT class_id, CAST(count(*) AS BIGINT) AS n FROM det WHERE confidence >= 0.55 GROUP BY class_id", "det")
def confidence_floor(spark, sf):
    return src.detections(spark, sf).filter("confidence >= 0.55D").groupBy("class_id").agg(lb.count_rows("n"))


@query(
    "fi11_class_keep_list",
    f"""SELECT f.frame_id, f.split, CAST(count(new_id) AS BIGINT) AS n_kept, count(new_id) = 0 AS background
FROM frames f LEFT JOIN (SELECT frame_id, {case('class_id', {0: 0, 2: 1, 5: 2, 9: 3})} AS new_id FROM det) d USING (frame_id) GROUP BY ALL""",
    "det frames",
)
def class_keep_list(spark, sf):
    kept = lb.keep_classes(src.detections(spark, sf), {0: 0, 2: 1, 5: 2, 9: 3})
    n = kept.groupBy("frame_id").agg(lb.count_rows("n"))
    return src.frames(spark, sf).join(n, "frame_id", "left").select(
        "frame_id", "split", F.coalesce("n", F.lit(0)).alias("n_kept"), F.col("n").isNull().alias("background")
    )


@query(
    "fi9_pseudo_label_triage",
    """WITH p AS (SELECT f.frame_id, CAST(count(*) FILTER (confidence >= 0.8) AS BIGINT) AS n_high, count(*) FILTER (confidence >= 0.3) AS n_all
  FROM frames f LEFT JOIN det USING (frame_id) GROUP BY 1),
r AS (SELECT * FROM (VALUES (true), (false)) v(reviewer))
SELECT reviewer, CASE WHEN n_high > 0 THEN 'keep' WHEN n_all > 0 AND reviewer THEN 'review' WHEN n_all = 0 THEN 'negative' ELSE 'dropped' END AS fate,
  CAST(count(*) AS BIGINT) AS n_frames, CAST(sum(n_high) AS BIGINT) AS n_boxes FROM p, r GROUP BY ALL""",
    "det frames",
)
def pseudo_label_triage(spark, sf):
    def run(reviewer):
        t = lb.triage(src.frames(spark, sf), src.detections(spark, sf), 0.8, 0.3, reviewer)
        return t.groupBy("fate").agg(lb.count_rows("n_frames"), F.sum("n_high").alias("n_boxes")).withColumn(
            "reviewer", F.lit(reviewer)
        )

    return run(True).unionByName(run(False))


@query(
    "fi10_unlabelled_excluded",
    "SELECT split, CAST(count(*) AS BIGINT) AS n FROM frames f WHERE EXISTS (SELECT 1 FROM det d WHERE d.frame_id = f.frame_id) GROUP BY split",
    "det frames",
)
def unlabelled_excluded(spark, sf):
    labelled = src.frames(spark, sf).join(src.detections(spark, sf), "frame_id", "left_semi")
    return labelled.groupBy("split").agg(lb.count_rows("n"))


# --- IoU and cross-source merge ----------------------------------------------------------


@query(
    "fn11_overlapping_pairs",
    """WITH p AS (SELECT a.frame_id, a.det_no AS a_no, b.det_no AS b_no,
  greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i,
  (a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1) AS s
  FROM det a JOIN det b ON a.frame_id = b.frame_id AND a.det_no < b.det_no)
SELECT frame_id, a_no, b_no, r6(CAST(i AS DOUBLE)/(s-i)) AS iou FROM p WHERE CAST(i AS DOUBLE)/(s-i) > 0.5""",
    "det",
)
def overlapping_pairs(spark, sf):
    p = bx.overlapping_pairs(src.detections(spark, sf), ["frame_id"], "det_no")
    return p.select("frame_id", F.col("a_rank").alias("a_no"), F.col("b_rank").alias("b_no"), g.round_half_even(F.col("iou")).alias("iou"))


MERGED = """RECURSIVE o AS (SELECT frame_id, class_id, det_no, source, x1, y1, x2, y2,
  row_number() OVER (PARTITION BY frame_id, class_id ORDER BY CASE source WHEN 'ocr' THEN 0 ELSE 1 END, det_no) AS k
  FROM det WHERE source IN ('ocr', 'llm')),
r AS (SELECT frame_id, class_id, 0::BIGINT AS k, CAST([] AS STRUCT(a INT, b INT, c INT, d INT, n BIGINT)[]) AS kept FROM o GROUP BY ALL
  UNION ALL
  SELECT r.frame_id, r.class_id, o.k, CASE WHEN o.source = 'ocr' OR NOT list_bool_or(list_prepend(false, list_transform(r.kept, lambda e:
      (greatest(0, least(e.c, o.x2)-greatest(e.a, o.x1))*greatest(0, least(e.d, o.y2)-greatest(e.b, o.y1)))*3
      > ((e.c-e.a)*(e.d-e.b) + (o.x2-o.x1)*(o.y2-o.y1)))))
    THEN list_append(r.kept, {'a': o.x1, 'b': o.y1, 'c': o.x2, 'd': o.y2, 'n': o.det_no}) ELSE r.kept END
  FROM r JOIN o ON o.frame_id = r.frame_id AND o.class_id = r.class_id AND o.k = r.k + 1),
last AS (SELECT frame_id, class_id, arg_max(kept, k) AS kept FROM r GROUP BY ALL),
m AS (SELECT frame_id, class_id, unnest(kept).n AS det_no FROM last)"""


@query("jo8_source_merge", f"WITH {MERGED} SELECT frame_id, class_id, det_no FROM m", "det")
def source_merge(spark, sf):
    m = bx.merge_sources(src.detections(spark, sf), ["frame_id", "class_id"], "det_no", "ocr", "llm")
    return m.select("frame_id", "class_id", "det_no")


RAN = "((source = 'ocr' AND frame_id % 5 <> 0) OR (source = 'llm' AND frame_id % 3 <> 0))"


@query(
    "pr21_frame_label",
    f"""WITH {MERGED.replace("WHERE source IN ('ocr', 'llm')", "WHERE " + RAN)}
SELECT f.frame_id, CAST(count(m.det_no) AS BIGINT) AS n_boxes, CAST(count(*) FILTER (d.source = 'ocr') AS BIGINT) AS n_ocr,
  CAST(count(*) FILTER (d.source = 'llm') AS BIGINT) AS n_llm, list_filter(['ocr', 'llm'], lambda s: CASE s WHEN 'ocr' THEN f.frame_id % 5 <> 0 ELSE f.frame_id % 3 <> 0 END) AS sources,
  CASE WHEN f.frame_id % 3 <> 0 THEN any_value(t.expected_state) END AS state
FROM frames f JOIN truth t USING (frame_id) LEFT JOIN det d ON d.frame_id = f.frame_id AND {RAN.replace('source', 'd.source').replace('frame_id', 'd.frame_id')}
LEFT JOIN m ON m.frame_id = d.frame_id AND m.det_no = d.det_no GROUP BY f.frame_id""",
    "det frames truth",
)
def frame_label(spark, sf):
    # which source ran on a frame is known from the run, whether it found boxes or not
    frames = src.frames(spark, sf).select("frame_id", (F.col("frame_id") % 5 != 0).alias("ocr"), (F.col("frame_id") % 3 != 0).alias("llm"))
    d = src.detections(spark, sf).filter(RAN)
    merged = bx.merge_sources(d, ["frame_id", "class_id"], "det_no", "ocr", "llm")
    n = merged.groupBy("frame_id").agg(lb.count_rows("n_boxes"))
    raw = d.groupBy("frame_id").agg(
        F.count_if(F.col("source") == "ocr").alias("n_ocr"), F.count_if(F.col("source") == "llm").alias("n_llm")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        frames.join(raw, "frame_id", "left").join(n, "frame_id", "left")
        .join(src.ground_truth(spark, sf).select("frame_id", F.col("expected_state").alias("state")), "frame_id")
        .select(
            "frame_id", zero("n_boxes"), zero("n_ocr"), zero("n_llm"),
            F.array_compact(F.array(F.when(F.col("ocr"), "ocr"), F.when(F.col("llm"), "llm"))).alias("sources"), F.when(F.col("llm"), F.col("state")).alias("state"),
        )
    )


# --- aggregates ------------------------------------------------------------------------


@query(
    "ag1_dataset_stats",
    """SELECT class_id, (SELECT CAST(count(*) AS BIGINT) FROM frames) AS n_images, CAST(count(*) AS BIGINT) AS n_boxes
FROM det GROUP BY ROLLUP (class_id)""",
    "det frames",
)
def dataset_stats(spark, sf):
    return lb.dataset_stats(src.frames(spark, sf), src.detections(spark, sf))


FEATURES = ", ".join(f"coalesce(max(confidence) FILTER (class_id = {i}), 0)" for i in range(lb.N)) + ", " + ", ".join(
    f"CAST(count(*) FILTER (class_id = {i}) AS DOUBLE)" for i in range(lb.N)
)


@query("ag4_frame_features", f"SELECT frame_id, [{FEATURES}] AS features FROM det GROUP BY frame_id", "det")
def frame_features(spark, sf):
    return lb.frame_features(src.detections(spark, sf))


@query(
    "ud6_feature_totals",
    f"""WITH f AS (SELECT frame_id, [{FEATURES}] AS v FROM det GROUP BY frame_id),
u AS (SELECT unnest(range(0, {2 * lb.N})) AS pos, unnest(v) AS x FROM f)
SELECT CAST(pos AS INT) AS pos, round(sum(x), 4) AS total, CAST(count(*) FILTER (x > 0) AS BIGINT) AS n_filled FROM u GROUP BY pos""",
    "det",
)
def feature_totals(spark, sf):
    v = lb.frame_features(src.detections(spark, sf)).select(F.posexplode("features").alias("pos", "x"))
    return v.groupBy("pos").agg(F.round(F.sum("x"), 4).alias("total"), F.count_if(F.col("x") > 0).alias("n_filled"))


SET_STATE = f"""CASE WHEN list_contains(c, '请求条目') THEN '捐兵-消息列表' WHEN list_contains(c, '捐赠确认按钮') THEN '捐兵-增援确认'
 WHEN list_has_any(c, ['下一个按钮', '搜索对手按钮']) THEN '搜索中' WHEN list_contains(c, '返回按钮') THEN '战斗结束'
 WHEN list_has_any(c, {['结束战斗按钮'] + vocab.RESOURCE_CLASSES}) THEN '战斗中'
 WHEN list_has_any(c, ['进攻按钮', '增援按钮']) THEN '村庄待机' END"""


@query(
    "ag14_state_by_class_set",
    f"""SELECT f.frame_id, {SET_STATE} AS state FROM frames f LEFT JOIN (SELECT frame_id, list(DISTINCT type) AS c FROM named GROUP BY 1) USING (frame_id)""",
    "named frames",
)
def state_by_class_set(spark, sf):
    return lb.infer_states(src.frames(spark, sf), src.named_detections(spark, sf))


@query(
    "ag16_label_run_summary",
    f"""WITH {MERGED.replace("WHERE source IN ('ocr', 'llm')", "WHERE " + RAN)}, s AS (SELECT f.frame_id, CASE WHEN f.frame_id % 3 <> 0 THEN any_value(t.expected_state) END AS state, count(m.det_no) AS n,
  count(*) FILTER (d.source = 'ocr') AS n_ocr, count(*) FILTER (d.source = 'llm') AS n_llm
  FROM frames f JOIN truth t USING (frame_id) LEFT JOIN det d ON d.frame_id = f.frame_id AND {RAN.replace('source', 'd.source').replace('frame_id', 'd.frame_id')}
  LEFT JOIN m ON m.frame_id = d.frame_id AND m.det_no = d.det_no GROUP BY f.frame_id)
SELECT state, CAST(count(*) AS BIGINT) AS n_frames, CAST(sum(n) AS BIGINT) AS n_boxes, CAST(sum(n_ocr) AS BIGINT) AS n_ocr,
  CAST(sum(n_llm) AS BIGINT) AS n_llm, CAST(count(*) FILTER (n = 0) AS BIGINT) AS n_empty FROM s WHERE state IS NOT NULL GROUP BY state ORDER BY n_frames DESC, state""",
    "det frames truth",
)
def label_run_summary(spark, sf):
    # a frame without a state has no part in the summary by state
    labels = frame_label(spark, sf).filter("state IS NOT NULL")
    return labels.groupBy("state").agg(
        lb.count_rows("n_frames"), F.sum("n_boxes").alias("n_boxes"), F.sum("n_ocr").alias("n_ocr"),
        F.sum("n_llm").alias("n_llm"), F.count_if(F.col("n_boxes") == 0).alias("n_empty"),
    ).orderBy(F.desc("n_frames"), "state")


@query(
    "ag17_split_class_cube",
    """SELECT f.split, d.class_id, CAST(count(*) AS BIGINT) AS n_boxes, CAST(count(DISTINCT f.frame_id) AS BIGINT) AS n_frames
FROM frames f JOIN det d USING (frame_id) GROUP BY CUBE (f.split, d.class_id)""",
    "det frames",
)
def split_class_cube(spark, sf):
    # a frame's boxes meet in one task: each of its classes counts it once, its first class counts it for all classes, and a frame has one
    # split. So the cube is made of the few cells of split and class, and no set of frames is kept
    per = src.spread(src.detections(spark, sf).select("frame_id", "class_id"), "frame_id").groupBy("frame_id", "class_id").agg(lb.count_rows("n"))
    frames = src.spread(src.frames(spark, sf).select("frame_id", "split"), "frame_id").groupBy("frame_id", "split").agg(lb.count_rows("copies"))
    first = F.row_number().over(Window.partitionBy("frame_id").orderBy("class_id")) == 1
    cells = frames.join(per, "frame_id").withColumn("first", first.cast("bigint")).groupBy("split", "class_id").agg(
        F.sum(F.col("n") * F.col("copies")).alias("n"), lb.count_rows("frames"), F.sum("first").alias("firsts")
    )
    return cells.cube("split", "class_id").agg(
        F.sum("n").alias("n_boxes"), F.when(F.grouping("class_id") == 0, F.sum("frames")).otherwise(F.sum("firsts")).alias("n_frames")
    )


@query(
    "ag25_button_conversion",
    f"""WITH {ocr_sql(BASE_RULES)}, n AS (SELECT f.frame_id, count(ob.det_no) AS n FROM frames f LEFT JOIN ob USING (frame_id) GROUP BY 1)
SELECT 'images_with_buttons' AS metric, CAST(NULL AS INT) AS class_id, CAST(count(*) FILTER (n > 0) AS BIGINT) AS value FROM n
UNION ALL SELECT 'no_button_images', NULL, count(*) FILTER (n = 0) FROM n
UNION ALL SELECT 'boxes', class_id, count(*) FROM ob GROUP BY ROLLUP (class_id)""",
    "ocr frames",
)
def button_conversion(spark, sf):
    b = bx.ocr_boxes(src.ocr_results(spark, sf), W, H)
    per = b.groupBy("frame_id").agg(lb.count_rows("n"))
    counts = src.frames(spark, sf).select("frame_id").join(per, "frame_id", "left").agg(
        F.count("n").alias("images_with_buttons"), F.count_if(F.col("n").isNull()).alias("no_button_images")
    )
    flat = counts.unpivot([], ["images_with_buttons", "no_button_images"], "metric", "value").withColumn(
        "class_id", F.lit(None).cast("int")
    )
    classes = b.rollup("class_id").agg(lb.count_rows("value")).withColumn("metric", F.lit("boxes"))
    return flat.unionByName(classes)


# --- joins and unions of data sets ---------------------------------------------------------


@query(
    "jo1_image_label_join",
    """WITH copies AS (SELECT frame_id, split, 0 AS source FROM frames UNION ALL SELECT frame_id, 'copy', 1 FROM frames WHERE frame_id % 4 = 0),
lab AS (SELECT frame_id, CASE WHEN frame_id % 8 = 0 THEN 1 ELSE 0 END AS source, CAST(min(det_no) AS BIGINT) AS first_label, CAST(count(*) AS BIGINT) AS n_lines FROM det GROUP BY 1
  UNION ALL SELECT frame_id, 1, CAST(min(det_no) AS BIGINT), CAST(count(*) AS BIGINT) FROM det WHERE frame_id % 12 = 0 AND frame_id % 8 <> 0 GROUP BY 1),
j AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY source) AS k FROM copies JOIN lab USING (frame_id, source))
SELECT frame_id, split, source, first_label, n_lines FROM j WHERE k = 1""",
    "det frames",
)
def image_label_join(spark, sf):
    # two folders hold images of one name; every eighth label file lies in the second folder, some lie in both
    fid = F.col("frame_id")
    frames = src.frames(spark, sf).select("frame_id", "split")
    copies = frames.withColumn("source", F.lit(0)).union(frames.filter(fid % 4 == 0).select("frame_id", F.lit("copy"), F.lit(1)))
    per = src.detections(spark, sf).groupBy("frame_id").agg(F.min("det_no").cast("bigint").alias("first_label"), lb.count_rows("n_lines"))
    own = F.when(fid % 8 == 0, F.array(F.lit(1))).when(fid % 12 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return lb.images_with_labels(copies, per.withColumn("source", F.explode(own)), "frame_id").select("frame_id", "split", "source", "first_label", "n_lines")


@query(
    "jo2_class_lookup",
    f"""WITH t AS (SELECT CASE class_id WHEN 6 THEN '进攻！按钮' WHEN 15 THEN '确认增援按钮（绿色）' WHEN 16 THEN '部队选择栏' WHEN 3 THEN '???'
  ELSE type END AS spelled FROM named), r AS (SELECT spelled, {case('spelled', vocab.TEACHER_ALIASES, 'spelled')} AS name FROM t)
SELECT spelled, d.class_id, CAST(count(*) AS BIGINT) AS n FROM r JOIN class_dim d ON d.class_name = r.name GROUP BY ALL""",
    "named class_dim",
)
def class_lookup(spark, sf):
    cid = F.col("class_id")
    spelled = (
        F.when(cid == 6, "进攻！按钮").when(cid == 15, "确认增援按钮（绿色）").when(cid == 16, "部队选择栏")
        .when(cid == 3, "???").otherwise(F.col("type"))
    )
    t = src.named_detections(spark, sf).select(spelled.alias("spelled"))
    name = F.coalesce(vocab.lookup(F.col("spelled"), vocab.TEACHER_ALIASES), F.col("spelled"))
    t = t.groupBy("spelled").agg(lb.count_rows("n")).withColumn("class_name", name)
    return t.join(F.broadcast(vocab.class_dim(spark)), "class_name").select("spelled", "class_id", "n")


@query(
    "jo20_saved_or_model_boxes",
    """WITH saved_frames AS (SELECT frame_id FROM frames WHERE frame_id % 3 = 0),
b AS (SELECT frame_id, det_no, class_id, 'saved' AS origin FROM det JOIN saved_frames USING (frame_id) WHERE source <> 'ocr'
  UNION ALL SELECT frame_id, det_no, class_id, 'model' FROM det WHERE frame_id NOT IN (SELECT frame_id FROM saved_frames) AND class_id < 12)
SELECT * FROM b""",
    "det frames",
)
def saved_or_model_boxes(spark, sf):
    d = src.detections(spark, sf).select("frame_id", "det_no", "class_id", "source")
    # a saved file may be empty and still hides the model's boxes
    saved_frames = src.frames(spark, sf).filter("frame_id % 3 = 0").select("frame_id")
    saved = d.filter("source <> 'ocr'").join(saved_frames, "frame_id", "left_semi").withColumn("origin", F.lit("saved"))
    model = d.filter("class_id < 12").join(saved_frames, "frame_id", "left_anti").withColumn("origin", F.lit("model"))
    return saved.unionByName(model).drop("source")


def box_sources(spark, sf):
    d = src.detections(spark, sf)
    rows = lambda s: d.filter(F.col("source") == s).groupBy("frame_id").agg(
        lb.count_rows("n_boxes")
    ).withColumn("dataset", F.lit(s))
    return {s: rows(s) for s in ("local", "llm", "ocr")}


@query(
    "se1_prefixed_union",
    """SELECT regexp_replace('set ' || source, '[^\\p{L}\\p{N}]', '_', 'g') || '_' || frame_id AS stem, CAST(count(*) AS BIGINT) AS n_boxes FROM det GROUP BY source, frame_id""",
    "det",
)
def prefixed_union(spark, sf):
    parts = [
        df.withColumn("stem", F.concat_ws("_", tx.safe_name(F.concat(F.lit("set "), "dataset")), F.col("frame_id")))
        for df in box_sources(spark, sf).values()
    ]
    return lb.first_writer_wins(parts, ["stem"]).select("stem", "n_boxes")


@query(
    "ag21_merge_summary",
    "SELECT source || '_' || split AS part, CAST(count(DISTINCT frame_id) AS BIGINT) AS n FROM det JOIN frames USING (frame_id) GROUP BY ALL",
    "det frames",
)
def merge_summary(spark, sf):
    per = src.detections(spark, sf).select("source", "frame_id").distinct()
    return per.join(src.frames(spark, sf), "frame_id").groupBy(F.concat_ws("_", "source", "split").alias("part")).agg(
        lb.count_rows("n")
    )


STATE_IN = """SELECT frame_id, 'a' AS input, expected_state AS state FROM truth
UNION ALL SELECT frame_id, 'b', CASE WHEN frame_id % 7 = 0 THEN '' ELSE '搜索中' END FROM frames"""


def state_inputs(spark, sf):
    a = src.ground_truth(spark, sf).selectExpr("frame_id", "'a' AS input", "expected_state AS state")
    b = src.frames(spark, sf).selectExpr(
        "frame_id", "'b' AS input", "CASE WHEN frame_id % 7 = 0 THEN '' ELSE '搜索中' END AS state"
    )
    return a.unionByName(b)


@query("se2_state_label_union", STATE_IN, "truth frames")
def state_label_union(spark, sf):
    return state_inputs(spark, sf)


@query(
    "ag24_valid_states",
    f"""SELECT input, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (state IS NOT NULL AND state <> '') AS BIGINT) AS n_valid
FROM ({STATE_IN}) GROUP BY ROLLUP (input)""",
    "truth frames",
)
def valid_states(spark, sf):
    return state_inputs(spark, sf).rollup("input").agg(
        lb.count_rows("n"), F.count_if(F.coalesce(F.col("state"), F.lit("")) != "").alias("n_valid")
    )


@query(
    "se3_three_way_union",
    """WITH u AS (SELECT source, frame_id, count(*) AS n FROM det GROUP BY ALL)
SELECT frame_id, arg_min(source, CASE source WHEN 'local' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END) AS dataset,
  CAST(arg_min(n, CASE source WHEN 'local' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END) AS BIGINT) AS n_boxes FROM u GROUP BY frame_id""",
    "det",
)
def three_way_union(spark, sf):
    return lb.first_writer_wins(list(box_sources(spark, sf).values()), ["frame_id"]).select("frame_id", "dataset", "n_boxes")


@query(
    "se4_pseudo_label_merge",
    """WITH have AS (SELECT 'pseudo_' || frame_id AS stem FROM frames WHERE split = 'val' UNION ALL SELECT CAST(frame_id AS VARCHAR) FROM frames WHERE split = 'train'),
p AS (SELECT DISTINCT 'pseudo_' || frame_id AS stem FROM det WHERE confidence >= 0.8)
SELECT stem, 'old' AS origin FROM have UNION ALL SELECT stem, 'new' FROM p WHERE stem NOT IN (SELECT stem FROM have)""",
    "det frames",
)
def pseudo_label_merge(spark, sf):
    fr = src.frames(spark, sf)
    have = fr.select(
        F.when(F.col("split") == "val", F.concat(F.lit("pseudo_"), "frame_id")).otherwise(F.col("frame_id").cast("string")).alias("stem")
    )
    new = src.detections(spark, sf).filter("confidence >= 0.8D").select(F.concat(F.lit("pseudo_"), "frame_id").alias("stem")).distinct()
    return have.withColumn("origin", F.lit("old")).unionByName(
        new.join(have, "stem", "left_anti").withColumn("origin", F.lit("new"))
    )


@query(
    "se5_class_set_operations",
    f"""SELECT frame_id, list_sort(list_intersect(c, {vocab.RESOURCE_CLASSES})) AS resources, list_sort(list_filter(c, lambda x: NOT list_contains({vocab.RESOURCE_CLASSES}, x))) AS others
FROM (SELECT frame_id, list(DISTINCT type) AS c FROM named GROUP BY 1)""",
    "named",
)
def class_set_operations(spark, sf):
    sets = src.named_detections(spark, sf).groupBy("frame_id").agg(F.collect_set("type").alias("c"))
    res = F.array(*[F.lit(n) for n in vocab.RESOURCE_CLASSES])
    return sets.select(
        "frame_id", F.array_sort(F.array_intersect("c", res)).alias("resources"),
        F.array_sort(F.array_except("c", res)).alias("others"),
    )


# --- splits and quotas ----------------------------------------------------------------------


@query(
    "wi8_shuffled_split",
    """WITH r AS (SELECT frame_id, row_number() OVER (ORDER BY md5('42|' || frame_id), frame_id) AS rn, count(*) OVER () AS n FROM frames)
SELECT frame_id, rn <= greatest(1, CAST(trunc(n*0.2::DOUBLE) AS BIGINT)) AS is_val FROM r""",
    "frames",
)
def shuffled_split(spark, sf):
    return splits.split_whole(src.frames(spark, sf).select("frame_id"), "frame_id", 0.2)


@query(
    "wi9_stratified_split",
    """WITH r AS (SELECT frame_id, det_no, class_id, source, row_number() OVER (PARTITION BY class_id, source ORDER BY md5('42|' || frame_id || '|' || det_no), frame_id, det_no) AS rn,
  count(*) OVER (PARTITION BY class_id, source) AS n FROM det)
SELECT frame_id, det_no, class_id, source, rn <= CASE WHEN n > 1 THEN greatest(1, CAST(trunc(n*0.2::DOUBLE) AS BIGINT)) ELSE 0 END AS is_val FROM r""",
    "det",
)
def stratified_split(spark, sf):
    d = src.detections(spark, sf).select("frame_id", "det_no", "class_id", "source")
    return splits.split_per_group(d, ["class_id", "source"], ["frame_id", "det_no"], 0.2)


@query(
    "wi7_background_quota",
    """WITH RECURSIVE n AS (SELECT split, frame_id, count(d.det_no) AS n, row_number() OVER (PARTITION BY split ORDER BY frame_id) AS k
  FROM frames LEFT JOIN (SELECT * FROM det WHERE class_id = 5) d USING (frame_id) GROUP BY split, frame_id),
r AS (SELECT split, CAST(NULL AS BIGINT) AS frame_id, 0::BIGINT AS k, 0::BIGINT AS kept, 0::BIGINT AS bg, false AS ok FROM n GROUP BY split
  UNION ALL
  SELECT r.split, n.frame_id, n.k,
    r.kept + CASE WHEN n.n > 0 OR r.bg + 1 <= 0.5::DOUBLE * greatest(1, r.kept) THEN 1 ELSE 0 END,
    r.bg + CASE WHEN n.n = 0 THEN 1 ELSE 0 END, n.n > 0 OR r.bg + 1 <= 0.5::DOUBLE * greatest(1, r.kept)
  FROM r JOIN n ON n.split = r.split AND n.k = r.k + 1)
SELECT split, frame_id, ok AS kept FROM r WHERE frame_id IS NOT NULL""",
    "det frames",
)
def background_quota(spark, sf):
    kept = lb.keep_classes(src.detections(spark, sf), {5: 0})
    return lb.background_quota(src.frames(spark, sf), kept, 0.5).select("split", "frame_id", "kept")


@query(
    "tk6_frame_cap",
    """SELECT frame_id, session_id FROM (SELECT frame_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY frame_id) AS rn FROM frames) WHERE rn <= 5""",
    "frames",
)
def frame_cap(spark, sf):
    from pyspark.sql import Window

    # a rank filter under a window limit is cut on the map side before the shuffle
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy("frame_id"))
    return src.frames(spark, sf).select("frame_id", "session_id").withColumn("rn", rn).filter("rn <= 5").drop("rn")
