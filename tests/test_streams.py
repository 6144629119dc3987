"""Streams over several micro-batches agree with their batch twins."""

import random

from pyspark.sql import functions as F

from sightlog.operators import machines as ma
from sightlog.operators import replay as rp
from sightlog.streaming import streams as st


def write_log(spark, folder):
    rnd = random.Random(9)
    rows = [(rnd.randint(1, 4), t, 1_700_000_000 + 60 * t, rnd.randint(0, 9)) for t in range(240)]
    df = spark.createDataFrame(rows, "s INT, event_id BIGINT, sec BIGINT, v INT").withColumn("ts", F.timestamp_seconds("sec"))
    for i in range(4):  # one file per part of the time range, read one per trigger in the order of arrival
        df.filter(F.col("event_id").between(60 * i, 60 * i + 59)).coalesce(1).write.mode("append").parquet(f"{folder}/log.parquet")
    return df


COLS = ["s", "event_id", "ts", "v", "v = 0 AS attack", "v = 1 AS search", "v = 2 AS next_b", "v = 3 AS return_b", "v IN (4, 5, 6) AS end_b",
        "CASE WHEN v >= 8 THEN 1 ELSE 0 END AS n_targets", "false AS all_full", "CAST(NULL AS BOOLEAN) AS worth"]


def test_machine_gate_and_counters(spark, tmp_path):
    log = write_log(spark, str(tmp_path))
    stream = lambda: st.table_stream(spark, str(tmp_path), "log", 1)
    key = ["s", "event_id", "state", "action"]
    replayed = lambda end: st.machine_stream(end.joined(stream().selectExpr(*COLS)), "s", ma.battle_machine())
    want = ma.replay(log.selectExpr(*COLS), ["s"], ["event_id"], ma.battle_machine()).select(*key)
    end = st.End(spark, "m")
    got = st.run_to_table(replayed(end), "m", end).select(*key)
    assert got.count() == 240 and got.exceptAll(want).count() == 0
    # as long as the source may go on, rows wait until the watermark, an hour behind the last row, has passed their bucket
    open_end = st.run_to_table(replayed(st.End(spark, "open")), "open").select(*key)
    assert 160 < open_end.count() <= 179 and open_end.exceptAll(want).count() == 0

    end = st.End(spark, "g")
    gate = st.run_to_table(st.gate_stream(end.joined(stream()), "s", "v", 2, 7), "g", end).select("s", "event_id", "flagged")
    twin = rp.hysteresis(log, ["s"], ["event_id"], F.col("v"), 2, 7, "flagged").select("s", "event_id", "flagged")
    assert gate.exceptAll(twin).count() == 0 and gate.count() == 240

    route = [F.when(F.col("v") > 6, "llm").otherwise("local").alias("route"), F.lit(5).alias("prompt_tokens"), F.lit(2).alias("completion_tokens")]
    closed = st.run_to_table(st.route_counters(stream().select("ts", *route), "30 minutes", "10 minutes", "15 minutes"), "c")
    rows = closed.orderBy("start").collect()
    batch = log.groupBy(F.window("ts", "30 minutes", "15 minutes").alias("w")).agg(F.count("*").alias("n")).selectExpr("w.start AS start", "n")
    twin = {r.start: r.n for r in batch.collect()}
    assert rows and all(twin[r.start] == r.total == r.local + r.llm for r in rows)


def test_first_contents(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "i INT, text STRING")
    df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i"))).repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    out = st.run_to_table(st.first_contents(st.table_stream(spark, str(tmp_path), "d", 1), "text", "1 hour"), "f")
    assert sorted(r.text for r in out.collect()) == [f"text {i}" for i in range(7)]


def test_files_out_of_order_and_late_rows(spark, tmp_path):
    rows = [(t % 2, t, 1_700_000_000 + 60 * t, (7 * t) % 10) for t in range(240)]
    df = spark.createDataFrame(rows, "s INT, event_id BIGINT, sec BIGINT, v INT").withColumn("ts", F.timestamp_seconds("sec"))
    # the second half hour comes after the third; row 0 comes when the watermark has long passed it
    files = [range(1, 30), range(60, 90), range(30, 60), range(90, 240), [0]]
    for i, part in enumerate(files):
        df.filter(F.col("event_id").isin(list(part))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
    end = st.End(spark, "late")
    got, late = st.run_counted(st.gate_stream(end.joined(st.table_stream(spark, str(tmp_path), "log", 1)), "s", "v", 2, 7), "late", end)
    twin = rp.hysteresis(df.filter("event_id > 0"), ["s"], ["event_id"], F.col("v"), 2, 7, "flagged").select("s", "event_id", "flagged")
    assert got.select("s", "event_id", "flagged").exceptAll(twin).count() == 0 and got.count() == 239
    assert late == 1


def test_state_is_forgotten_and_begins_anew(spark, tmp_path):
    # key 1 falls silent for more than thirty days, key 2 does not
    rows = [(1, 0, 0, 1), (2, 1, 0, 1), (2, 2, 20, 5), (2, 3, 40, 5), (1, 4, 60, 5), (2, 5, 60, 5)]
    df = spark.createDataFrame(rows, "s INT, event_id BIGINT, day BIGINT, v INT").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("day") * 86400))
    for day in (0, 20, 40, 60):
        df.filter(F.col("day") == day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log.parquet")
    end = st.End(spark, "forget")
    got = st.run_to_table(st.gate_stream(end.joined(st.table_stream(spark, str(tmp_path), "log", 1)), "s", "v", 2, 7), "forget", end)
    assert {r.event_id: r.flagged for r in got.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: True}


class Store:
    """State of one key in memory, with the number of calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, *_):  # noqa: N802
        return StoredValue(self, name)

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


class StoredValue:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def at(self, key=()):
        self.store.calls += 1
        return self.name, key

    def exists(self):
        return self.at() in self.store.values

    def get(self):
        return self.store.values.get(self.at())

    def update(self, value):
        self.store.values[self.at()] = value

    def clear(self):
        self.store.values.pop(self.at(), None)

    def containsKey(self, key):  # noqa: N802
        return self.at(key) in self.store.values

    def getValue(self, key):  # noqa: N802
        return self.store.values.get(self.at(key))

    def updateValue(self, key, value):  # noqa: N802
        self.store.values[self.at(key)] = value

    def removeKey(self, key):  # noqa: N802
        self.store.values.pop(self.at(key), None)


def test_store_calls_follow_keys_not_buckets(monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    rnd = random.Random(4)
    minutes = rnd.sample(range(40_000), 500)
    rows = pd.DataFrame({"ts": pd.to_datetime([60 * m for m in minutes], unit="s"), "event_id": range(500), "held": [m % 10 for m in minutes], st.End.MARK: False})

    def feed(parts, marks):
        store, out = Store(), []
        fold = st.Replay("s", {"event_id": "bigint", "held": "int"}, "bigint", 0, lambda s, v: (s * 3 + v) % 1009 and (s * 3 + v, s) or (0, s))
        fold.init(store)
        for part, mark in zip(parts, marks, strict=True):
            list(fold.handleInputRows((1,), iter([part]), None))
            passed = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
            while due := [t for t in store.timers if t < mark]:
                first = min(due)
                out += [i for pdf in fold.handleExpiredTimer((1,), passed, SimpleNamespace(getExpiryTimeInMs=lambda at=first: at)) for i in pdf["event_id"]]
                store.timers.discard(first)
        return out, store

    want = [i for _, i in sorted(zip(minutes, range(500), strict=True))]
    out, store = feed([rows], [1 << 50])
    assert out == want and store.calls < 40 and not store.values
    # several batches whose times overlap, in chunks of few rows, some of them out before the others come
    monkeypatch.setattr(st, "CHUNK", 16, raising=False)
    late = rows["ts"] >= pd.Timestamp(60 * 20_000, unit="s")
    out, store = feed([rows[~late][::2], rows[~late][1::2], rows[late]], [0, 60_000 * 19_000, 1 << 50])
    assert out == want and not store.values
