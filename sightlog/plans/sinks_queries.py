"""Queries that write a result to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.operators import audit as au
from sightlog.operators import boxes as bx
from sightlog.operators import catalogue as ct
from sightlog.operators import labels as lb
from sightlog.operators import splits
from sightlog.operators import teacher as te
from sightlog.plans import audit_queries as aq
from sightlog.plans import boxes_queries as bq
from sightlog.plans import pages_queries as pq
from sightlog.plans import sessions_queries as sq
from sightlog.plans.registry import query
from sightlog.session import materialise, scratch_path
from sightlog.sources import sinks
from sightlog.sources import tables as src

W, H = src.CANVAS

SPLIT = """sp AS (SELECT frame_id, CASE WHEN rn <= greatest(1, CAST(trunc(n*0.2::DOUBLE) AS BIGINT)) THEN 'val' ELSE 'train' END AS sp FROM (
  SELECT frame_id, row_number() OVER (ORDER BY md5('42|' || frame_id), frame_id) AS rn, count(*) OVER () AS n FROM {0}))"""


def split_column(frames):
    s = splits.split_whole(frames.select("frame_id"), "frame_id", 0.2)
    return s.select("frame_id", F.when(F.col("is_val"), "val").otherwise("train").alias("split"))


@query(
    "sk1_labelled_dataset",
    f"""WITH {bq.MERGED}, {SPLIT.format('frames')}
SELECT sp AS split, CAST(count(DISTINCT sp.frame_id) AS BIGINT) AS n_frames, CAST(count(m.det_no) AS BIGINT) AS n_lines FROM sp LEFT JOIN m USING (frame_id) GROUP BY sp""",
    "det frames",
)
def labelled_dataset(spark, sf):
    frames = src.frames(spark, sf).select("frame_id")
    split = split_column(frames)
    d = src.detections(spark, sf)
    merged = bx.merge_sources(d, ["frame_id", "class_id"], "det_no", "ocr", "llm")
    n = g.normalised(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(W), F.lit(H))
    lines = g.add_clamped(merged.withColumn("n", n), "b", *[F.col("n")[f] for f in bq.BOX])
    lines = lines.select("frame_id", "det_no", g.box_line(F.col("class_id"), F.col("b")).alias("line")).join(split, "frame_id")
    states = src.ground_truth(spark, sf).select("frame_id", F.col("expected_state").alias("state")).join(split, "frame_id")
    out = scratch_path(spark, "dataset")
    sinks.write_dataset(lines, states, out)
    a = spark.read.parquet(f"{out}/states").groupBy("split").agg(lb.count_rows("n_frames"))
    b = spark.read.parquet(f"{out}/labels").groupBy("split").agg(lb.count_rows("n_lines"))
    return a.join(b, "split", "left").select(F.col("split").cast("string").alias("split"), "n_frames", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("sk7_class_manifest", "SELECT class_id, class_name, CAST(count(d.frame_id) AS BIGINT) AS n FROM class_dim LEFT JOIN det d USING (class_id) GROUP BY ALL", "det class_dim")
def class_manifest(spark, sf):
    out = scratch_path(spark, "classes")
    sinks.write_label_map(spark, out)
    names = spark.read.schema("class_id INT, class_name STRING").json(f"{out}/classes")
    n = src.detections(spark, sf).groupBy("class_id").agg(lb.count_rows("n"))
    return F.broadcast(names).join(n, "class_id", "left").select("class_id", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "sk4_session_summaries",
    f"""SELECT s.*, 'battle' AS module, 30 AS max_steps, total_steps AS n_records, corrected AS n_corrected FROM ({sq.SUMMARY}) s""",
    sq.PAIR_VIEWS,
)
def session_summaries(spark, sf):
    out = scratch_path(spark, "summaries")
    summary = te.session_summary(sq.local(spark, sf), sq.teacher(spark, sf))
    steps = te.step_records(sq.local(spark, sf), sq.teacher(spark, sf))
    sinks.write_summaries(summary, steps, "battle", 30, out)
    heads = spark.read.schema(summary.schema.add("module", "string").add("max_steps", "integer")).json(f"{out}/summary")
    records = spark.read.schema(steps.schema).json(f"{out}/steps").groupBy("session_id").agg(
        lb.count_rows("n_records"), F.count_if("corrected").alias("n_corrected")
    )
    return heads.join(records, "session_id")


@query(
    "sk2_retrain_extract",
    f"""WITH {bq.OBJ}, lo AS (SELECT frame_id, class_id FROM named WHERE source <> 'llm' AND x2 > x1 AND x1 < {W} AND y1 < {H}),
v AS (SELECT frame_id, det_no, class_id, CASE WHEN m = 0 THEN [b[1]*{W}, b[2]*{H}, b[3]*{W}, b[4]*{H}]
    WHEN m = 1 AND list_min(b) >= 0 AND list_max(b) <= 1 THEN [b[1]*{W}, b[2]*{H}, b[3]*{W}, b[4]*{H}] WHEN m = 1 THEN [b[1]*{W}/1280::DOUBLE, b[2]*{H}/960::DOUBLE, b[3]*{W}/1280::DOUBLE, b[4]*{H}/960::DOUBLE]
    WHEN p IS NOT NULL THEN (SELECT [cx-{bq.PW}*{W}/2, cy-{bq.PH}*{H}/2, cx+{bq.PW}*{W}/2, cy+{bq.PH}*{H}/2] FROM (SELECT CASE WHEN list_max(p) <= 1 THEN p[1]*{W} ELSE p[1]*{W}/1280::DOUBLE END AS cx,
      CASE WHEN list_max(p) <= 1 THEN p[2]*{H} ELSE p[2]*{H}/960::DOUBLE END AS cy)) END AS v FROM obj WHERE (frame_id, det_no) IN (SELECT (frame_id, det_no) FROM det WHERE source = 'llm')),
te AS (SELECT frame_id, class_id FROM v WHERE v IS NOT NULL AND least({W}, v[3]) > greatest(0, least(v[1], v[3])) AND least({H}, v[4]) > greatest(0, least(v[2], v[4]))),
a AS (SELECT * FROM lo UNION ALL SELECT * FROM te), fr AS (SELECT DISTINCT frame_id FROM a), {SPLIT.format('fr')}
SELECT sp AS split, class_id, CAST(count(*) AS BIGINT) AS n_boxes FROM a JOIN sp USING (frame_id) GROUP BY ALL""",
    "named",
)
def retrain_extract(spark, sf):
    """Local boxes and the teacher's missed objects as one training set, split by whole samples."""
    d = src.named_detections(spark, sf)
    w, h = F.lit(W), F.lit(H)
    local = d.filter("source <> 'llm'").select("frame_id", "det_no", "class_id", *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    local = g.add_clamped_to_image(local, "b", F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), w, h)
    missed = bq.teacher_objects(spark, sf).join(d.filter("source = 'llm'").select("frame_id", "det_no"), ["frame_id", "det_no"], "left_semi")
    missed = missed.withColumn("type", F.coalesce(vocab.lookup(F.col("type"), vocab.TEACHER_ALIASES), F.col("type")))
    missed = bx.add_legacy_box(missed, "b", w, h).withColumn("class_id", vocab.class_id_of(F.col("type"))).filter("class_id IS NOT NULL")
    keep = ["frame_id", "det_no", "class_id", "b"]
    boxes = local.select(*keep).unionByName(missed.select(*keep))
    boxes = boxes.withColumn("n", g.normalised(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), w, h))
    lines = boxes.select("frame_id", "det_no", "class_id", g.box_line(F.col("class_id"), F.col("n")).alias("line"))
    # the split reads its samples several times: their keys are stored, so that no box is made again for them
    split = split_column(materialise(boxes.select("frame_id").distinct()))
    states = src.ground_truth(spark, sf).selectExpr("frame_id", "expected_state AS state").join(split, "frame_id")
    out = scratch_path(spark, "retrain")
    sinks.write_dataset(lines.join(split, "frame_id"), states, out)
    return spark.read.parquet(f"{out}/labels").groupBy(F.col("split").cast("string").alias("split"), "class_id").agg(lb.count_rows("n_boxes"))


@query(
    "sk5_catalogue_records",
    f"""SELECT p_partkey || '-' || p_brand AS link, p_type AS module, 2 AS n_properties, CAST(p_size AS VARCHAR) AS num, '/u/' || p_partkey AS canonical,
  ['升级 ' || p_size % 3, '其他'] AS labels, [['1', p_size::VARCHAR], ['2', 'a b']] AS cells, ['first ' || p_partkey, 'second note'] AS notes, n AS n_images
  FROM part JOIN (SELECT p_partkey, CAST(count(*) AS INT) AS n FROM ({pq.OWNED}) GROUP BY ALL) USING (p_partkey)""",
)
def catalogue_records(spark, sf):
    out = scratch_path(spark, "catalogue")
    details = ct.detail_records(pq.detail_pages(spark, sf), "p_partkey").drop("text")
    sinks.write_catalogue(ct.index_items(pq.index_pages(spark, sf)), details, out)
    back = spark.read.schema(details.schema).json(f"{out}/items")
    return back.selectExpr(
        "link", "module", "size(properties) AS n_properties", "building_num[0].num AS num", "canonical", "transform(tables, t -> t.label) AS labels",
        "tables[0].rows AS cells", "notes", "aggregate(image_groups, 0, (n, g) -> n + size(g.images)) AS n_images",
    )


@query("sk6_report_file", f"WITH {aq.FOUND} SELECT CAST(count(*) AS BIGINT) AS n_findings, CAST(5 * count(*) AS BIGINT) AS n_entries, CAST(7 AS BIGINT) AS n_table_lines FROM found")
def report_file(spark, sf):
    out = scratch_path(spark, "report")
    sinks.write_report(au.report_lines(aq.records(spark, sf), aq.corpus(spark, sf), au.gate_config(), "markdown"), out)
    # a finding is a heading and five entries; the severities are a table with two head lines
    text = spark.read.text(out)
    return text.agg(
        F.count_if(F.col("value").startswith("### ")).alias("n_findings"), F.count_if(F.col("value").rlike(r"^- \*\*(Location|Title|Description|Snippet|Fix suggestion):\*\* ")).alias("n_entries"),
        F.count_if(F.col("value").startswith("|")).alias("n_table_lines"),
    )
