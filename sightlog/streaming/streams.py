"""Keyed streams: the replay operators and counters on unbounded input.

Rows of a key wait in chunks until the watermark has passed their bucket of event time; a timer then releases them, in the order of
(ts, event_id). A micro-batch touches the chunks it adds or releases and a short index, not what else waits. State lives in the state store, its
checkpoint in the shared folder. A source that has come to its end is told so by ``End``, whose mark lets the watermark pass everything.
"""

from __future__ import annotations

import bisect
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightlog.functions import text as tx
from sightlog.operators import machines as ma
from sightlog.operators import routing as rt
from sightlog.session import scratch_path


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A stored table, one file or a folder of files, as a stream of its files."""
    table = f"{folder}/{name}.parquet"
    stored = spark.read.parquet(table)
    is_file = any(f.endswith(f"/{name}.parquet") for f in stored.inputFiles())
    reader = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if is_file else reader.parquet(table)


DELAY, BUCKET_MS, EXPIRY_MS, CHUNK = "1 hour", 10 * 60 * 1000, 30 * 24 * 3600 * 1000, 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class End:
    """The end of a source, as a second stream with at most one row: a time after all others, in no group that counts."""

    # names with a leading underscore do not reach the processor
    MARK = "at_end"

    def __init__(self, spark: SparkSession, name: str):
        self.folder = scratch_path(spark, f"{name}-end")

    def joined(self, rows: DataFrame, ts: str = "ts") -> DataFrame:
        """``rows`` with the column MARK, and the mark row once it is written."""
        spark = rows.sparkSession
        empty = spark.createDataFrame([], "_at TIMESTAMP")
        empty.write.mode("append").parquet(self.folder)
        mark = spark.readStream.schema("_at TIMESTAMP").parquet(self.folder)
        cols = [F.col("_at").alias(c) if c == ts else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
        return rows.withColumn(self.MARK, F.lit(False)).unionByName(mark.select(*cols, F.lit(True).alias(self.MARK)))

    def write(self, spark: SparkSession) -> None:
        spark.createDataFrame([(datetime.datetime(2200, 1, 1),)], "_at TIMESTAMP").write.mode("append").parquet(self.folder)


class Replay(StatefulProcessor):
    """``state, result = step(state, value)`` per row of a key, once the watermark has passed the row's bucket.

    State per key: the fold's state with the time up to which rows are out, the waiting rows in sorted chunks, and an index of the chunks. The calls
    to the store follow the number of keys and chunks, not that of buckets: one timer waits for the earliest bucket, and when it fires, all
    buckets that the watermark has passed come out, chunk by chunk. A key without rows for EXPIRY_MS of event time is forgotten.
    """

    def __init__(self, key: str, types: dict[str, str], state: str, start, step):
        self.key, self.types, self.state_type, self.start, self.step = key, types, state, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", f"s {self.state_type}, upto bigint")
        self.waiting = handle.getMapState("waiting", "chunk bigint", f"at array<bigint>, id array<{self.types['event_id']}>, v array<{self.types['held']}>")
        # the first time of each waiting chunk, by its number
        self.index = handle.getValueState("index", "first array<bigint>, chunk array<bigint>")

    def chunks(self) -> list[tuple[int, int]]:
        found = self.index.get()
        return [] if found is None else list(zip(*found, strict=True))

    def put(self, chunks: list[tuple[int, int]], rows: list[tuple]) -> None:
        """Adds sorted rows as chunks."""
        number = max((c for _, c in chunks), default=-1) + 1
        for low in range(0, len(rows), CHUNK):
            part = rows[low : low + CHUNK]
            self.waiting.updateValue((number,), tuple(map(list, zip(*part, strict=True))))
            chunks.append((part[0][0], number))
            number += 1

    def store(self, chunks: list[tuple[int, int]], timer: int | None) -> None:
        """Keeps the index, and a timer at the end of the earliest bucket unless it is there already."""
        if not chunks:
            self.index.clear()
            return
        self.index.update(tuple(map(list, zip(*chunks, strict=True))))
        due = _bucket_end(min(chunks)[0])
        if due != timer:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks, timer = None, None
        for pdf in rows:
            at = pdf["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            ended = pdf[End.MARK].tolist() if End.MARK in pdf else [False] * len(at)
            taken = sorted(
                ((t, i, None if pd.isna(v) else v) for t, i, v, e in zip(at, pdf["event_id"].tolist(), pdf["held"].tolist(), ended, strict=True) if not e),
                key=lambda r: r[:2],
            )
            if taken and chunks is None:
                chunks = self.chunks()
                timer = _bucket_end(min(chunks)[0]) if chunks else None
            if taken:
                self.put(chunks, taken)
        if chunks is not None:
            self.store(chunks, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state, upto = self.current.get() or (self.start, None)
        if now % BUCKET_MS:  # the time to forget, unless newer rows have come
            if upto is not None and upto + EXPIRY_MS + 1 == now:
                self.current.clear()
            return
        passed = max(now, timerValues.getCurrentWatermarkInMs() // BUCKET_MS * BUCKET_MS)
        chunks = sorted(self.chunks())
        due = [c for c in chunks if c[0] < passed * 1000]
        if not due:
            return
        last, held, done, results = None, [], [], []
        for (_, number), bound in zip(due, [*(first for first, _ in due[1:]), passed * 1000], strict=True):
            rows = zip(*self.waiting.getValue((number,)), strict=True)
            self.waiting.removeKey((number,))
            held = sorted([*held, *rows], key=lambda r: r[:2])
            # what a later chunk may come before has to wait for it
            out = bisect.bisect_left(held, bound, key=lambda r: r[0])
            for last, i, v in held[:out]:
                state, r = self.step(state, v)
                done.append(i)
                results.append(r)
            held = held[out:]
            if len(done) >= CHUNK:
                yield self.result(key, done, results)
                done, results = [], []
        chunks = chunks[len(due) :]
        self.put(chunks, held)
        self.store(chunks, None)
        if upto is not None:
            self.handle.deleteTimer(upto + EXPIRY_MS + 1)
        upto = _bucket_end(last)
        self.handle.registerTimer(upto + EXPIRY_MS + 1)
        self.current.update((state, upto))
        if done:
            yield self.result(key, done, results)

    def result(self, key, done: list, results: list) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(done), "event_id": done, "_out": pd.Series(results, dtype=object)})


def _bucket_end(at: int) -> int:
    """The end in milliseconds of the bucket of a time in microseconds."""
    return (at // 1000 // BUCKET_MS + 1) * BUCKET_MS


def _stateful(df: DataFrame, key: str, value: str, state: str, start, step, out: str, delay: str = DELAY) -> DataFrame:
    """Each row with the result of a fold along its key in the order of (ts, event_id); ``state`` and ``out`` are SQL types.

    Files may come in any order within ``delay``; what comes later still is dropped and counted by the engine (``run_counted``). Rows without
    a time are not taken.
    """
    marked = [End.MARK] if End.MARK in df.columns else []
    rows = df.withWatermark("ts", delay).select(key, "ts", "event_id", F.col(value).alias("held"), *marked)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{key} {types[key]}, event_id {types['event_id']}, _out {out}"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(Replay(key, types, state, start, step), schema, "Append", "EventTime")


def machine_stream(steps: DataFrame, key: str, machine: ma.Machine) -> DataFrame:
    """State and action after each step of a state machine."""
    coded = steps.withColumn("_code", machine.code())
    out = _stateful(coded, key, "_code", "INT", machine.states.index(machine.start), ma.stepper(machine), "INT")
    return ma.decode(out, machine).drop("_out")


def gate_stream(steps: DataFrame, key: str, value: str, low: float, resume: float) -> DataFrame:
    """Hysteresis flag per step."""
    def step(flag, v):
        if v is not None:
            flag = (flag or v <= low) and not v >= resume
        return flag, flag

    return _stateful(steps, key, value, "BOOLEAN", False, step, "BOOLEAN").withColumnRenamed("_out", "flagged")


def route_counters(log: DataFrame, length: str, delay: str, slide: str | None = None) -> DataFrame:
    """Route totals per window; rows behind the watermark are dropped and counted by the engine."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    t = rt.totals(log.withWatermark("ts", delay), w)
    return t.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in t.columns if c != "window"])


def session_summaries(steps: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Summary of each session, closed by a gap."""
    s = steps.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(F.col("event_type") == "purchase").alias("executed"),
        F.count_if(F.col("event_type") == "error").alias("corrected"),
    )
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "total_steps", "executed", "corrected")


def first_contents(rows: DataFrame, content: str, delay: str) -> DataFrame:
    """First row of each content; the seen digests are kept for ``delay``."""
    return (
        rows.withColumn("digest", tx.digest(F.col(content))).withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["digest"])
    )


def run_counted(df: DataFrame, name: str, end: End | None = None) -> tuple[DataFrame, int]:
    """Run a stream over everything available into a table of the shared folder; that table, and the number of rows that
    came too late. With ``end`` the source is at its end afterwards, and what still waits comes out."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    dropped: dict[tuple, int] = {}

    def run(which: int) -> None:
        q = (
            df.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        )
        over = False
        while not over:
            # the engine keeps the last hundred reports only, so they are read while it runs
            over = q.awaitTermination(1)
            for p in q.recentProgress:
                dropped[which, p.batchId] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    run(0)
    if end is not None:
        end.write(spark)
        run(1)
    return spark.read.schema(df.schema).parquet(f"{out}/data"), sum(dropped.values())


def run_to_table(df: DataFrame, name: str, end: End | None = None) -> DataFrame:
    return run_counted(df, name, end)[0]
