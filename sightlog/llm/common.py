"""Shared helpers: tables, Arrow batches, connected components, the query registry."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightlog.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words are runs without ASCII white space; ``bytes.split()`` cuts at just these characters.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its reference SQL, if there is one."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, work: Callable[..., list]) -> DataFrame:
    """``work`` gets one list per column of an Arrow batch and returns one list (or array) per output column.

    Spark bounds a batch by rows and bytes, so a task holds one batch whatever the table's size.
    """
    fields = T._parse_datatype_string(schema).fields if not isinstance(schema, T.StructType) else schema.fields
    names = [f.name for f in fields]
    types = [_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            out = work(*(column.to_pylist() for column in batch.columns))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    plain = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
    }
    return plain[type(kind)]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): one row (id, root) per id in an edge, root the smallest id.

    Alternating stars: the minimum of a neighbourhood is a partial aggregate, so a hub is never gathered in a
    task, and the join that spreads it may be split. Each round is cut with a reliable checkpoint; the number
    of rounds grows with the logarithm of the longest path. Null ends and loops name no link.
    """
    e = edges.select("a", "b").where("a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ids = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
    before = _digest(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        far = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(far.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = materialise(near.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _digest(e)
        if now == before:
            break
        before = now
    return ids.join(e.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")
    )


def _digest(e: DataFrame):
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
