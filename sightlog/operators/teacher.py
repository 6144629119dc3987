"""Teacher output: free-form JSON to typed rows, samples to training boxes, session summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.functions import text as tx

OBJECT_SCHEMA = "type STRING, coords STRING, position_estimate STRING, bbox STRING, confidence DOUBLE"
POINT = "ARRAY<DOUBLE>"
VERDICT_SCHEMA = f"""approved BOOLEAN, corrected_state STRING, reasoning STRING,
 corrected_action STRUCT<kind: STRING, target: STRING, coords: {POINT}, troop_coords: {POINT}>,
 missed_objects ARRAY<STRUCT<type: STRING, bbox: {POINT}>>,
 resource_buildings ARRAY<STRUCT<type: STRING, center: {POINT}>>"""
STEP_SCHEMA = "ARRAY<STRUCT<action: STRING, target: STRING, coords: STRING, reason: STRING>>"
ACTION_SCHEMA = f"kind STRING, target STRING, coords {POINT}, troop_coords {POINT}"


def objects_to_detections(objects: DataFrame, json_col: str = "payload") -> DataFrame:
    """Teacher objects with a type and a positive point; an unusable confidence counts as 0.5."""
    c = F.col
    o = objects.withColumn("_o", F.from_json(json_col, OBJECT_SCHEMA))
    box = F.when(F.size(F.regexp_extract_all(c("_o.bbox"), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))) >= 4, c("_o.bbox"))
    o = o.withColumn(
        "_p", F.coalesce(tx.number_pair(c("_o.coords")), tx.number_pair(c("_o.position_estimate")), tx.number_pair(box))
    )
    o = g.keep_when(o, (c("_p.x") > 0) & (c("_p.y") > 0) & (c("_o.type") != ""), "_q", c("_p"))
    conf = F.coalesce(F.nullif(c("_o.confidence"), F.lit(0.0)), F.lit(0.5))
    return o.select(
        *[n for n in objects.columns if n != json_col], c("_o.type").alias("type"), c("_q.x").alias("x"), c("_q.y").alias("y"),
        F.when(conf.between(0.0, 1.0), conf).otherwise(0.5).alias("confidence"),
    )


def scaled_point(p: Column, size: tuple[int, int], seen: tuple[int, int]) -> Column:
    """Fractions of the image, or pixels of the canvas the teacher saw; half to even.

    Values at most 1 are fractions; a negative fraction is no point at all.
    """
    x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    point = lambda a, b: F.struct(F.rint(a).cast("bigint").alias("x"), F.rint(b).cast("bigint").alias("y"))
    unit = (x <= 1) & (y <= 1)
    return (
        F.when(x.isNull() | y.isNull(), None)
        .when(unit & (x >= 0) & (y >= 0), point(x * size[0], y * size[1]))
        .when(~unit, point(x * size[0] / seen[0], y * size[1] / seen[1]))
    )


def legacy_bbox(b: Column, size: tuple[int, int], legacy=(1280.0, 960.0)) -> Column:
    unit = F.forall(F.slice(b, 1, 4), lambda v: (v >= 0) & (v <= 1))
    out = []
    for i in range(4):
        s, old = size[i % 2], legacy[i % 2]
        out.append(F.when(unit, F.get(b, F.lit(i)) * s).otherwise(F.get(b, F.lit(i)) * s / old))
    return F.when(F.size(b) >= 4, F.array(*out))


def parse_verdicts(rows: DataFrame, json_col: str, size: tuple[int, int], seen: tuple[int, int]) -> DataFrame:
    """Verdict text to columns; every part is optional on its own, anything but an object is an error."""
    v = rows.withColumn("_v", F.from_json(json_col, VERDICT_SCHEMA))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(json_col)).startswith("OBJECT"), F.lit(False))
    return v.select(
        *[c for c in rows.columns if c != json_col],
        F.when(~is_object, "not an object").alias("error"),
        (is_object & F.coalesce("_v.approved", F.lit(False))).alias("approved"),
        F.when(is_object, F.col("_v.corrected_state")).alias("corrected_state"),
        F.when(is_object, F.coalesce("_v.reasoning", F.lit(""))).alias("reasoning"),
        F.col("_v.corrected_action.kind").alias("kind"),
        F.col("_v.corrected_action.target").alias("target"),
        scaled_point(F.col("_v.corrected_action.coords"), size, seen).alias("coords"),
        scaled_point(F.col("_v.corrected_action.troop_coords"), size, seen).alias("troop_coords"),
        F.transform(
            F.coalesce("_v.missed_objects", F.array()),
            lambda o: F.struct(o["type"].alias("type"), legacy_bbox(o["bbox"], size).alias("bbox")),
        ).alias("missed"),
        F.filter(
            F.transform(
                F.filter("_v.resource_buildings", lambda r: r["type"].isin(vocab.RESOURCE_CLASSES)),
                lambda r: F.struct(r["type"].alias("type"), scaled_point(r["center"], size, seen).alias("point")),
            ),
            lambda r: r["point"].isNotNull(),
        ).alias("resources"),
    )


def plan_candidates(rows: DataFrame, json_col: str) -> DataFrame:
    """Deploy steps of a teacher plan as unscored candidates; unusable points become (0, 0)."""
    steps = rows.select(
        *[c for c in rows.columns if c != json_col], F.posexplode(F.from_json(json_col, STEP_SCHEMA)).alias("pos", "s")
    ).filter(F.lower("s.action") == "deploy")
    nums = F.from_json("s.coords", POINT)
    x, y = F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
    ok = x.isNotNull() & y.isNotNull()
    return steps.select(
        *[c for c in rows.columns if c != json_col], "pos",
        F.coalesce("s.target", F.lit("未知")).alias("name"),
        F.when(ok, x.cast("int")).otherwise(0).alias("x"),
        F.when(ok, y.cast("int")).otherwise(0).alias("y"),
        F.lit(0.0).alias("score"), F.lit("llm").alias("source"),
        F.coalesce("s.reason", F.lit("")).alias("reason"),
    )


def parse_actions(rows: DataFrame, json_col: str) -> DataFrame:
    """Action text to typed columns; the kind is mandatory, coordinates are cut to integers."""
    a = rows.withColumn("_a", F.from_json(json_col, ACTION_SCHEMA)).filter("_a.kind IS NOT NULL")
    at = lambda f, i: F.get(F.col("_a." + f), F.lit(i)).cast("int")
    return a.select(
        *[c for c in rows.columns if c != json_col], F.col("_a.kind").alias("kind"), F.col("_a.target").alias("target"),
        at("coords", 0).alias("x"), at("coords", 1).alias("y"),
        at("troop_coords", 0).alias("troop_x"), at("troop_coords", 1).alias("troop_y"),
    )


def sample_fate(samples: DataFrame) -> DataFrame:
    """Fate of each teacher sample, in this order: corrupt, no image, missing file, duplicate
    content, no boxes, converted.

    Of equal contents the first name stays. Contents meet as digests with map-side minimum and
    the surviving names are joined back by name, so a content with very many copies makes
    no large group.
    """
    fate = (
        F.when(F.col("meta").isNull(), "corrupt")
        .when(F.col("meta.image").isNull() | (F.col("meta.image") == ""), "no_image")
        .when(F.col("content").isNull(), "mismatch")
    )
    s = samples.withColumn("_early", fate)
    first = (
        s.filter("_early IS NULL").groupBy(tx.digest(F.col("content")).alias("d")).agg(F.min("name").alias("name"))
        .select("name", F.lit(True).alias("_first"))
    )
    return (
        s.join(first, "name", "left")
        .withColumn(
            "fate",
            F.coalesce(
                "_early", F.when(F.col("_first").isNull(), "overlap").when(F.col("n_boxes") == 0, "no_objects"),
                F.lit("converted"),
            ),
        )
        .drop("_early", "_first")
    )


def step_states(local: DataFrame, teacher: DataFrame) -> DataFrame:
    """State per step: the teacher's if given, else the local one, else the step goes; '' is not given."""
    j = local.join(teacher, ["session_id", "step_no"], "left")
    state = F.coalesce(F.nullif("teacher_state", F.lit("")), F.nullif("local_state", F.lit("")))
    return j.withColumn("state", state).filter("state IS NOT NULL").select("session_id", "step_no", "state")


def session_summary(local: DataFrame, teacher: DataFrame) -> DataFrame:
    """Steps, approvals, corrections and executed actions per session; no review is neither."""
    j = local.join(teacher, ["session_id", "step_no"], "left")
    return (
        j.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("total_steps"),
            F.count_if(F.col("approved")).alias("approved"),
            F.count_if(~F.col("approved")).alias("corrected"),
            F.count_if("executed").alias("executed"),
        )
        .withColumn("correction_rate", F.round(F.col("corrected") / F.col("total_steps"), 3))
    )


def step_records(local: DataFrame, teacher: DataFrame) -> DataFrame:
    """One record per step as a session stores it: a step without review is neither approved nor corrected."""
    j = local.join(teacher.select("session_id", "step_no", "approved"), ["session_id", "step_no"], "left")
    return j.select(
        "session_id", "step_no", "local_state", "approved", F.coalesce(~F.col("approved"), F.lit(False)).alias("corrected"), "executed"
    )
