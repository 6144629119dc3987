"""Signals per frame, states by rule, and scores against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlog import vocab
from sightlog.functions import geometry as g
from sightlog.functions import text as tx
from sightlog.operators.segments import LARGE, row_numbers

SIGNALS = {"attack": "进攻按钮", "return": "返回按钮", "search": "搜索对手按钮", "next": "下一个按钮", "end": "结束战斗按钮"}
MIN_CONF = 0.25


def button_id(signal: str) -> int:
    return vocab.CLASSES.index(SIGNALS[signal])


def model_signals(boxes: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """Best box per button (highest confidence, first on a tie) and number of resource boxes.

    One aggregation with map-side combine; the pivot is over five fixed buttons.
    """
    c = F.col
    point = F.struct(g.centre(c("x1"), c("x2")).alias("x"), g.centre(c("y1"), c("y2")).alias("y"))
    rank = F.struct(c("confidence"), (-c("det_no")).alias("first"))
    aggs = [
        F.max_by(point, F.when(c("class_id") == button_id(s), rank)).alias(s) for s in SIGNALS
    ]
    return boxes.filter(c("confidence") >= min_conf).groupBy("frame_id").agg(
        *aggs, F.count_if(c("class_id") < len(vocab.RESOURCE_CLASSES)).alias("n_resources")
    )


def text_signals(results: DataFrame) -> DataFrame:
    """Button points from recognised text; a later text of the same button wins."""
    xs, ys = F.transform("bbox", lambda p: p["x"]), F.transform("bbox", lambda p: p["y"])
    point = F.struct(
        g.centre(F.array_min(xs), F.array_max(xs)).alias("x"), g.centre(F.array_min(ys), F.array_max(ys)).alias("y")
    )
    hits = g.keep_value(results, "cid", tx.button_class(F.col("text")))
    return hits.groupBy("frame_id").agg(
        *[F.max_by(point, F.when(F.col("cid") == button_id(s), F.col("det_no"))).alias(s) for s in SIGNALS]
    )


def first_rule(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """Label of the first rule that holds; an unknown condition does not hold."""
    out = None
    for label, cond in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def signal_state(seen) -> Column:
    """State by signal rules, in order; ``seen(signal)`` tells whether a signal is present."""
    return first_rule(
        [
            ("战斗中", seen("end") | seen("next")),
            ("村庄待机", seen("attack") & ~seen("end")),
            ("搜索中", seen("search") | seen("return")),
        ],
        vocab.UNKNOWN_STATE,
    )


def pick_signals(frames: DataFrame, model: DataFrame, text: DataFrame | None) -> DataFrame:
    """Model signals, or recognised text where the model saw nothing at all."""
    names = list(SIGNALS)
    out = frames.select("frame_id").join(model, "frame_id", "left")
    empty = F.coalesce(F.col("n_resources"), F.lit(0)) == 0
    for s in names:
        empty = empty & F.col(s).isNull()
    out = out.withColumn("model_empty", empty)
    if text is not None:
        other = text.select("frame_id", *[F.col(s).alias("t_" + s) for s in names])
        out = out.join(other, "frame_id", "left")
        out = out.withColumns({s: F.when(F.col("model_empty"), F.col("t_" + s)).otherwise(F.col(s)) for s in names})
        out = out.drop(*["t_" + s for s in names])
    return out.withColumn("n_resources", F.coalesce("n_resources", F.lit(0))).withColumn(
        "state", signal_state(lambda s: F.col(s).isNotNull())
    )


def rate(hit: Column, total: Column, digits: int = 4) -> Column:
    return F.when(total > 0, F.round(hit / total, digits))


def state_accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of right states; donation scenes are counted apart, unlabelled frames not at all."""
    j = pred.join(truth.select("frame_id", "expected_state"), "frame_id", "left")
    exp = F.coalesce("expected_state", F.lit(""))
    donation = exp.contains("捐兵")
    counted = (exp != "") & ~donation
    return j.agg(
        F.count_if(counted & (F.col("state") == exp)).alias("n_correct"),
        F.count_if(counted).alias("n_scored"),
        F.count_if(donation).alias("n_donation"),
    ).withColumn("accuracy", rate(F.col("n_correct"), F.col("n_scored")))


def signal_recall(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Found and expected per signal; frames where the signal is not expected do not count."""
    j = pred.join(truth, "frame_id", "left")
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(s).alias("signal"), F.coalesce(F.col("exp_" + s), F.lit(False)).alias("want"),
            F.col(s).isNotNull().alias("got"),
        ) for s in SIGNALS
    ])).alias("r")
    return (
        j.select(rows).select("r.*").groupBy("signal")
        .agg(F.count_if(F.col("want") & F.col("got")).alias("n_found"), F.count_if("want").alias("n_expected"))
        .withColumn("recall", rate(F.col("n_found"), F.col("n_expected")))
    )


def top_bar(results: DataFrame, height: int, fraction: float = 0.16) -> DataFrame:
    """Digits of texts that lie wholly above ``fraction`` of the image; a text without a box counts
    as lying at (0, 0). Numbers past the type are dropped."""
    mean = lambda f: F.aggregate(
        "bbox", F.lit(0.0), lambda a, p: a + p[f], lambda a: a / F.size("bbox")
    )
    boxed = F.coalesce(F.size("bbox") > 0, F.lit(False))
    high = (F.col("text") != "") & (~boxed | (F.array_max(F.col("bbox")["y"]) <= height * fraction))
    # no digits are no number either
    numbers = g.keep_when(results.select("frame_id", "text", "bbox"), high, "value", F.regexp_replace("text", "[^0-9]+", "").try_cast("bigint"))
    return numbers.select(
        "frame_id",
        F.when(boxed, mean("x")).otherwise(0.0).alias("cx"),
        F.when(boxed, mean("y")).otherwise(0.0).alias("cy"),
        "value",
    )


def resource_status(frames: DataFrame, numbers: DataFrame, storage: dict[str, int]) -> DataFrame:
    """The three leftmost numbers are gold, elixir and dark elixir; flags tell which are full."""
    rn = F.row_number().over(Window.partitionBy("frame_id").orderBy("cx", "cy", "value"))
    three = numbers.withColumn("rn", rn).filter("rn <= 3")
    names = list(storage)
    wide = three.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("detected"),
        *[F.max(F.when(F.col("rn") == i + 1, F.col("value"))).alias(n) for i, n in enumerate(names)],
    )
    out = frames.select("frame_id").join(wide, "frame_id", "left")
    out = out.withColumn("detected", F.coalesce("detected", F.lit(0)))
    flags = {n + "_full": F.coalesce(F.col(n) >= storage[n], F.lit(False)) for n in names}
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names} | flags)
    full = [F.col(n + "_full") for n in names]
    all_full = (F.col("detected") >= 2) & full[0] & full[1] & ((F.col("detected") < 3) | full[2])
    return out.withColumn("all_full", all_full)


def spoken_resources(frames: DataFrame, results: DataFrame) -> DataFrame:
    """Amounts from texts that name a resource; the last text per resource wins, 0 if none or past the type."""
    low = F.col("_low")
    kind = (
        F.when(low.contains("gold") | F.col("text").contains("金币"), "gold")
        .when(low.contains("elixir") | F.col("text").contains("圣水"), "elixir")
        .when(low.contains("dark") | F.col("text").contains("黑油"), "dark_elixir")
    )
    digits = F.regexp_extract(F.translate("text", ", ", ""), r"(\d+)", 1)
    hits = g.keep_value(results.select("frame_id", "det_no", "text", F.lower("text").alias("_low")), "kind", kind)
    hits = g.keep_value(hits, "digits", F.nullif(digits, F.lit("")))
    names = ["gold", "elixir", "dark_elixir"]
    wide = hits.groupBy("frame_id").agg(
        *[F.max_by(F.col("digits").try_cast("bigint"), F.when(F.col("kind") == n, F.col("det_no"))).alias(n) for n in names]
    )
    return frames.select("frame_id").join(wide, "frame_id", "left").select(
        "frame_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def known_resources(status: DataFrame, spoken: DataFrame) -> DataFrame:
    """(frame_id, resources): the amounts read from the bar if any number was, else those named in texts if any is positive, else NULL."""
    names = ["gold", "elixir", "dark_elixir"]
    c = F.col
    both = status.select("frame_id", "detected", *names).join(spoken.select("frame_id", *[c(n).alias(f"said_{n}") for n in names]), "frame_id", "left")
    amounts = lambda pre: F.struct(*[c(pre + n).cast("bigint").alias(n) for n in names])
    said = F.greatest(*[F.coalesce(f"said_{n}", F.lit(0)) for n in names]) > 0
    return both.select("frame_id", F.when(c("detected") > 0, amounts("")).when(said, amounts("said_")).alias("resources"))


def signal_points(boxes: DataFrame, segments: int | None = None, large: int = LARGE) -> DataFrame:
    """The point lists of each tick as rows (frame_id, kind, place, name, resource, x, y): all targets by vocabulary and detection order, all
    collectible icons and all request entries in detection order; ``place`` numbers a list from 1.

    ``boxes`` is (frame_id, det_no, type, x1, y1, x2, y2). Lists are rows, so a crowded frame is no long array; boxes at an unknown place do not count.
    A row moves as numbers: its place in the vocabulary stands for name, kind and resource.
    """
    c = F.col
    listed = [(n, "target", r) for n, r in vocab.BUILDING_RESOURCE.items()]
    n_targets = len(listed)
    listed += [(icon, "icon", resource) for resource, icon in vocab.COLLECT_ICONS.items()]
    n_points = len(listed)
    listed += [("请求条目", "request", None)]
    rows = boxes.select(
        "frame_id", "det_no", vocab.lookup(c("type"), {n: i for i, (n, _, _) in enumerate(listed)}).alias("_entry"),
        g.centre(c("x1"), c("x2")).alias("x"), g.centre(c("y1"), c("y2")).alias("y"),
    ).filter("x > 0 AND y > 0 AND _entry IS NOT NULL")
    target = c("_entry") < n_targets
    rows = rows.withColumns({
        "_kind": F.when(target, 0).when(c("_entry") < n_points, 1).otherwise(2), "_p": F.when(target, c("_entry")).otherwise(0),
    })
    placed = row_numbers(rows, ["frame_id", "_kind"], ["_p", "det_no"], "place", segments, large)
    entry = lambda k: vocab.lookup(c("_entry"), {i: e[k] for i, e in enumerate(listed)})
    return placed.select("frame_id", entry(1).alias("kind"), "place", entry(0).alias("name"), entry(2).alias("resource"), "x", "y")


def frame_signals(frames: DataFrame, boxes: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """One row per tick: first box per button in detection order, first target in vocabulary order
    and counts; boxes at an unknown place (x or y not positive) do not count. ``resources`` as ``known_resources`` gives them;
    the whole point lists are ``signal_points``."""
    c = F.col
    if resources is not None:
        frames = frames.select("frame_id").join(resources, "frame_id", "left")
    known = boxes.select(
        "frame_id", "det_no", "class_id",
        g.centre(c("x1"), c("x2")).alias("x"), g.centre(c("y1"), c("y2")).alias("y"),
    ).filter("x > 0 AND y > 0")
    point = F.struct("x", "y")
    ids = {s: vocab.CLASSES.index(n) for s, n in {
        **SIGNALS, "list": "消息列表按钮", "request": "请求条目", "reinforce": "增援按钮",
        "close": "关闭按钮", "confirm": "捐赠确认按钮", "troops": "兵种选择栏",
    }.items()}
    order = [vocab.CLASSES.index(n) for n in vocab.BUILDING_RESOURCE]
    place = vocab.lookup(c("class_id"), {cid: i for i, cid in enumerate(order)})
    wide = known.groupBy("frame_id").agg(
        *[F.min_by(point, F.when(c("class_id") == i, c("det_no"))).alias(s) for s, i in ids.items()],
        F.min_by(
            F.struct(c("class_id"), c("x"), c("y")), F.when(place.isNotNull(), F.struct(place.alias("p"), c("det_no")))
        ).alias("target"),
        F.count_if(place.isNotNull()).alias("n_targets"),
        F.count_if(c("class_id") == ids["request"]).alias("n_requests"),
    )
    kept = ["frame_id"] if resources is None else ["frame_id", "resources"]
    return frames.select(*kept).join(wide, "frame_id", "left").withColumns({
        "n_targets": F.coalesce("n_targets", F.lit(0)),
        "more_requests": F.when(c("n_requests") > 0, c("n_requests") > 1),
    })
