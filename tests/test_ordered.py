"""Ordered operators must give the same result whether or not a group is split over segments."""

import random

import pytest
from pyspark.sql import functions as F

from sightlog.operators import labels as lb
from sightlog.operators import machines as ma
from sightlog.operators import replay as rp
from sightlog.operators import splits
from sightlog.operators.segments import global_rank, machine_states, ordered, row_numbers

K, O = ["s"], ["t"]


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(5)
    # one session holds half of all rows
    rows = [(1 if rnd.random() < 0.5 else rnd.randint(2, 9), t, rnd.randint(0, 9)) for t in range(400)]
    return spark.createDataFrame(rows, "s INT, t INT, v INT"), rows


def by_session(rows):
    out = {}
    for s, t, v in rows:
        out.setdefault(s, []).append((t, v))
    return out


def run(df, *cols):
    return {(r["s"], r["t"]): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("limit", [None, 2, 32])
def test_gate_streak_ledger_run(log, limit):
    df, rows = log
    gate = run(rp.hysteresis(df, K, O, F.col("v"), 2, 7, "f", segments=limit), "f")
    streak = run(rp.streak(df, K, O, F.col("v") < 5, F.col("v") == 9, "n", segments=limit), "n")
    ledger = run(rp.ledger(df, K, O, F.col("v") - 5, "b", segments=limit), "b")
    length = run(rp.run_length(df, K, O, F.col("v") > 4, "l", segments=limit), "l")
    history = set(run(rp.changes(df, K, O, F.col("v") > 4, segments=limit)))
    for s, items in by_session(rows).items():
        flag, n, b, prev, l = False, 0, 0, None, 0
        for t, v in items:
            flag = (flag or v <= 2) and not v >= 7
            n = 0 if v == 9 else n + (v < 5)
            b = max(0, b + v - 5)
            l = l + 1 if prev is not None and (v > 4) == prev else 1
            assert ((s, t) in history) == (prev is None or (v > 4) != prev)
            prev = v > 4
            assert (gate[s, t], streak[s, t], ledger[s, t], length[s, t]) == ((flag,), (n,), (b,), (l,))


@pytest.mark.parametrize("limit", [None, 2, 32])
def test_machine_replay(spark, log, limit):
    df, rows = log
    steps = df.selectExpr(
        "s", "t", "v = 0 AS attack", "v IN (1) AS search", "v = 2 AS next_b", "v = 3 AS return_b", "v IN (4, 5, 6, 7) AS end_b",
        "CASE WHEN v = 8 THEN 2 ELSE 0 END AS n_targets", "false AS all_full", "CAST(NULL AS BOOLEAN) AS worth",
    )
    got = run(ma.replay(steps, K, O, ma.battle_machine(), limit), "state", "action")
    for s, items in by_session(rows).items():
        state, empties = "村庄待机", 0
        for t, v in items:
            act = "wait"
            if state == "村庄待机":
                if v == 0:
                    state, act = "搜索中", "tap 进攻按钮"
            elif state == "搜索中":
                if v == 3:
                    state, act = "村庄待机", "tap 返回按钮"
                elif v == 1:
                    act = "tap 搜索对手按钮"
                elif v == 8:
                    state, act, empties = "战斗中", "deploy", 0
                elif v == 2:
                    act = "tap 下一个按钮"
            elif state == "战斗中":
                if v == 8:
                    act, empties = "deploy", 0
                elif v == 3:
                    state = "战斗结束"
                elif v in (4, 5, 6, 7):
                    empties += 1
                    if empties >= 3:
                        state, act = "战斗结束", "tap 结束战斗按钮"
            elif v == 3:
                state, act = "村庄待机", "tap 返回按钮"
            assert got[s, t] == (state, act)


@pytest.mark.parametrize("limit", [None, 2, 32])
def test_frame_filter_and_quota(spark, log, limit):
    df, rows = log
    vec = df.select("s", "t", F.array(F.col("v").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    kept = set(run(rp.keep_changed_frames(vec, K, O, "vec", 1, 1.5, 10, limit)))
    for s, items in by_session(rows).items():
        last, n = None, 0
        for t, v in items:
            new = last is None or abs(v - last) / 2 >= 1.5
            if new:
                last, n = v, n + 1
            assert ((s, t) in kept) == (new and n <= 10)


@pytest.mark.parametrize("quota", [0.0, 0.1, 0.3, 0.5, 1.0, 1.7])
@pytest.mark.parametrize("share, segments", [(0.1, 3), (0.3, 9), (0.7, None)])
def test_background_quota(spark, monkeypatch, quota, share, segments):
    monkeypatch.setattr(lb, "BLOCK", 17)
    rnd = random.Random(int(quota * 10 + share * 100))
    boxed = {i for i in range(300) if rnd.random() < share}
    frames = spark.createDataFrame([("train" if i % 7 else "val", i) for i in range(300)], "split STRING, frame_id INT")
    boxes = spark.createDataFrame([(i, 0) for i in sorted(boxed)], "frame_id INT, class_id INT")
    got = {r.frame_id for r in lb.background_quota(frames, boxes, quota, segments).filter("kept").collect()}
    want = set()
    for split in (0, 1):
        kept, bg = 0, 0
        for i in (i for i in range(300) if bool(i % 7) == bool(split)):
            if i not in boxed:
                bg += 1
                if bg > quota * max(1, kept):
                    continue
            kept += 1
            want.add(i)
    assert got == want


def test_maps_compose_over_batches_and_segments(spark):
    rnd = random.Random(8)
    moves = [[rnd.randrange(5) for _ in range(3)] for _ in range(5)]
    rows = [(s, t, sum(rnd.randrange(3) << 4 * i for i in range(5))) for s in (None, 1, 2) for t in range(130)]
    df = spark.createDataFrame(rows, "s INT, t INT, code LONG")
    want = {}
    for s in (None, 1, 2):
        state = 3
        for _, t, code in (r for r in rows if r[0] == s):
            want[s, t] = (state,)
            state = moves[state][(code >> 4 * state) & 15]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for batch in (7, 10_000):
            spark.conf.set(size, batch)
            for segments in (1, 4, 32):
                assert run(segments_of(df, moves, segments), "_before") == want
    finally:
        spark.conf.set(size, before)


def segments_of(df, moves, segments):
    return machine_states(df, K, O, "code", moves, 3, segments)


def test_jobs_do_not_grow_with_segments(spark, log):
    df, _ = log
    steps = df.selectExpr("s", "t", "v = 0 AS attack", "v = 3 AS return_b", "CASE WHEN v = 8 THEN 2 ELSE 0 END AS n_targets", "false AS all_full")
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n in (4, 32):
        spark.sparkContext.setJobGroup(f"segments-{n}", "replay")
        ma.replay(steps, K, O, ma.farm_machine(), n).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"segments-{n}")))
    spark.sparkContext.setJobGroup("after", "")
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("limit", [None, 50])
def test_global_rank(spark, limit):
    df = spark.range(300).withColumn("k", F.md5(F.col("id").cast("string")))
    rows = global_rank(df, ["k"], "r", limit).orderBy("k").collect()
    assert [r.r for r in rows] == list(range(1, 301))


@pytest.mark.parametrize("n,ratio,want", [(0, 0.2, 0), (1, 0.2, 1), (2, 0.2, 1), (57, 0.2, 11), (57, 0.0, 0)])
def test_split_sizes(spark, n, ratio, want):
    df = splits.split_whole(spark.range(n), "id", ratio)
    assert df.filter("is_val").count() == want and df.count() == n


def test_split_per_group(spark):
    df = spark.range(101).withColumn("g", F.when(F.col("id") == 0, 0).otherwise(1 + F.col("id") % 2))
    got = {r.g: r.n for r in splits.split_per_group(df, ["g"], ["id"], 0.3).filter("is_val").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 15, 2: 15}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [10, 100, 1000])
def test_row_numbers_of_small_and_large_groups(spark, large):
    rnd = random.Random(7)
    # half of the rows in one group, some under no key, the rest in groups of a few
    rows = [(1 if rnd.random() < 0.5 else rnd.choice([None, *range(2, 60)]), t) for t in range(600)]
    rnd.shuffle(rows)
    got = row_numbers(spark.createDataFrame(rows, "s INT, t INT"), K, O, "n", 7, large).collect()
    seen, want = {}, set()
    for s, t in sorted(rows, key=lambda r: r[1]):
        seen[s] = seen.get(s, 0) + 1
        want.add((s, t, seen[s]))
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_row_numbers_store_nothing_and_move_rows_once(spark):
    rows = spark.range(1000).selectExpr("id % 300 AS s", "id AS t")
    logical, physical = plan_of(row_numbers(rows, K, O, "n"))
    assert "LogicalRDD" not in logical and physical.count("Exchange") == 1


def test_what_segments_hand_on_is_broadcast(spark, log):
    df, _ = log
    _, physical = plan_of(ordered(df, K, O, 4).row_number("n").result())
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
