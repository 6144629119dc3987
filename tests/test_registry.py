"""The registry covers the inventory, and every query agrees with its reference SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from sightlog.plans import all_queries, reference_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
def test_every_reference_query_has_a_spark_query():
    queries, sql = all_queries(), reference_sql()
    assert set(sql) <= set(queries) and len(queries) >= 200
    assert set(queries) <= set(entry.queries()) and set(sql) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries) == set(sql)


@pytest.fixture(scope="module")
def reference():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value as either side may give it: numbers by nine decimals, rows and maps as tuples."""
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


@pytest.mark.parametrize("name", sorted(reference_sql()))
def test_query_against_reference(spark, reference, name):
    got = all_queries()[name](spark, SF)
    want = reference.execute(reference_sql()[name])
    cols, there = sorted(got.columns), [d[0] for d in want.description]
    assert cols == sorted(there)
    have = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in got.collect())
    assert have == sorted(repr(tuple(plain(r[there.index(c)]) for c in cols)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
