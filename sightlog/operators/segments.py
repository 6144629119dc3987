"""Ordered computations over groups of any size.

A window over ``partitionBy(session)`` puts a whole session into one task. Here rows are range partitioned by (keys, order), so a
large group spans many partitions ("segments"), the window runs inside each segment, and what one segment hands to the next is
added afterwards from one summary row per segment. There is one way for all sizes; the number of jobs does not depend on the
number of segments. ``by_groups``, for very many groups, lays out only those that are too large for a task.

State machines are scanned the same way: a row is a map from states to states, maps are composed along a segment (doubling in
numpy, no step per row), and a segment's map carries the state on (``machine_states``).

Folds whose next state depends on a choice made from all states before have to run in order; ``in_order`` streams the sorted rows of
each group through one task, which holds a batch and the fold's state, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightlog.session import materialise

SEG = "_seg"
#: Bits of a packed map or rule number: at most 16 states, 16 rules each.
BITS = 4
#: Rows above which a group is laid out in segments by ``row_numbers``, and the hash buckets it counts.
LARGE = 1_000_000
BUCKETS = 65_536


def join_segments(rows: DataFrame, per_segment: DataFrame, by: list[str]) -> DataFrame:
    """``per_segment`` (one row per ``by``, which may hold NULL) to every row of ``rows``."""
    other = per_segment.withColumnsRenamed({k: f"_{i}_{k}" for i, k in enumerate(by)})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(other[f"_{i}_{k}"]) for i, k in enumerate(by)])
    return rows.join(other, same, "left").drop(*[f"_{i}_{k}" for i, k in enumerate(by)])


@dataclass
class Ordered:
    """Rows with keys, a total order within the keys and a segment number."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    #: Rows of equal order count as one moment: running values are those at its end.
    together: bool = False
    #: Each group lies in one segment, so nothing is handed on.
    whole: bool = False

    @property
    def _by(self) -> list[str]:
        return self.keys + [SEG]

    def _window(self):
        return Window.partitionBy(*self._by).orderBy(*self.order)

    def _so_far(self):
        w = self._window()
        return w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if self.together else w.rowsBetween(Window.unboundedPreceding, 0)

    def _carry_window(self):
        return Window.partitionBy(*self.keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)

    def _crossing(self) -> DataFrame:
        """Rows of groups that a segment begins or ends with, as no other can have rows in two segments."""
        if not self.keys:
            return self.df
        group = F.struct(*self.keys)
        ends = self.df.groupBy(SEG).agg(F.min(group).alias("_a"), F.max(group).alias("_z")).select(F.explode(F.array("_a", "_z")).alias("_group"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_group")[k]) for k in self.keys])
        return self.df.join(F.broadcast(ends), same, "left_semi")

    def _add(self, name: str, local: Column, summary: Column, carry: Column, join: Callable) -> "Ordered":
        if self.whole:
            return replace(self, df=self.df.withColumn(name, join(local, F.lit(None))))
        before = self._crossing().groupBy(*self._by).agg(summary.alias("_sum")).withColumn("_carry", carry).drop("_sum")
        # only the group that a segment starts with can have rows in earlier ones: one row a segment, so the rows stay where they are
        before = F.broadcast(before.filter("_carry IS NOT NULL"))
        df = join_segments(self.df.withColumn(name, local), before, self._by)
        return replace(self, df=df.withColumn(name, join(F.col(name), F.col("_carry"))).drop("_carry"))

    def running_sum(self, name: str, value: Column) -> "Ordered":
        """Sum over all rows up to and including this one."""
        return self._add(
            name, F.sum(value).over(self._so_far()), F.sum(value), F.sum("_sum").over(self._carry_window()),
            lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        )

    def running_max(self, name: str, value: Column) -> "Ordered":
        return self._add(
            name, F.max(value).over(self._so_far()), F.max(value), F.max("_sum").over(self._carry_window()),
            lambda a, b: F.greatest(a, b),
        )

    def last_value(self, name: str, value: Column) -> "Ordered":
        """Latest non-null value up to and including this row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        # a struct keeps the aggregate free of nulls: only rows with a value take part
        summary = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        return self._add(
            name, F.last(value, ignorenulls=True).over(w), summary,
            F.last("_sum", ignorenulls=True).over(self._carry_window()),
            lambda a, b: F.coalesce(a, b),
        )

    def previous(self, name: str, value: Column) -> "Ordered":
        """The value of the row before, NULL on the first row of the group."""
        boxed = F.struct(value.alias("v"))
        out = self._add(
            name, F.lag(boxed).over(self._window()), F.max_by(boxed, F.struct(*self.order)),
            F.last("_sum", ignorenulls=True).over(self._carry_window()),
            lambda a, b: F.coalesce(a, b),
        )
        return replace(out, df=out.df.withColumn(name, F.col(name)["v"]))

    def row_number(self, name: str) -> "Ordered":
        return self.running_sum(name, F.lit(1).cast("bigint"))

    def with_columns(self, **cols: Column) -> "Ordered":
        return replace(self, df=self.df.withColumns(cols))

    def result(self) -> DataFrame:
        return self.df.drop(SEG)


def lay_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int | None = None) -> DataFrame:
    """Rows sorted into range partitions, each a segment with its number; not yet stored."""
    by = [*keys, *order]
    ranged = df.repartitionByRange(segments, *by) if segments else df.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*by).withColumn(SEG, F.spark_partition_id())


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int | None = None, together: bool = False) -> Ordered:
    """Lay ``df`` out for ordered computation; ``order`` must be total within ``keys``, or sums and maxima be taken of equal rows ``together``.

    Without keys the whole table is one group. ``segments`` defaults to Spark's number of shuffle partitions.
    """
    # the segment of a row must not change between the summary and the scan, so it is stored
    return Ordered(materialise(lay_out(df, keys, order, segments)), list(keys), list(order), together)


def by_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], body: Callable[[Ordered], Ordered], segments: int | None = None, large: int = LARGE, together: bool = False,
) -> DataFrame:
    """Rows of ``df`` with what ``body`` adds to them, for many groups; ``order`` as for ``ordered``. ``df`` is read twice.

    Groups of up to ``large`` rows take one shuffle by key and a window. Whether there may be larger ones is told by the rows per hash bucket of the keys, one pass
    that moves a number per bucket; the rows of every bucket above ``large`` are laid out in segments, so that no task holds a larger group.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counted = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large)
    crowded = [r["_bucket"] for r in counted.collect()]
    near = df.filter(~bucket.isin(crowded)) if crowded else df
    found = body(Ordered(near.withColumn(SEG, F.lit(0)), list(keys), list(order), together, whole=True)).result()
    if not crowded:
        return found
    return found.unionByName(body(ordered(df.filter(bucket.isin(crowded)), keys, order, segments, together)).result())


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, segments: int | None = None, large: int = LARGE) -> DataFrame:
    """Position of each row in its group, from 1, for many groups; ``order`` must be total within ``keys``."""
    return by_groups(df, keys, order, lambda o: o.row_number(name), segments, large)


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", segments: int | None = None) -> DataFrame:
    """Position of each row in the order of the whole table, from 1."""
    return ordered(df, [], order, segments).row_number(name).result()


# --- scans of maps between states ----------------------------------------------------------------------


def group_starts(batch: pa.RecordBatch, keys: Sequence[str], before: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Whether each row begins a group (its keys differ from the row before), and the keys of the last row."""
    n = batch.num_rows
    starts = np.zeros(n, dtype=bool)
    last = []
    for i, k in enumerate(keys):
        column = batch.column(k)
        if n > 1:
            # two nulls are one key
            a, b = column.slice(1), column.slice(0, n - 1)
            same = pc.equal(a, b).fill_null(False)
            same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
            starts[1:] |= ~np.asarray(same)
        starts[0] |= before is None or before[i] != column[0].as_py()
        last.append(column[n - 1].as_py())
    starts[0] |= before is None
    return starts, tuple(last)


def compose_along(maps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Composition of the maps (rows x states) of each group up to and including each row, by doubling."""
    group, out, step = np.cumsum(starts), maps.copy(), 1
    while step < len(out):
        joined = group[step:] == group[:-step]
        if not joined.any():
            break
        late = out[step:]
        out[step:] = np.where(joined[:, None], np.take_along_axis(late, out[:-step], axis=1), late)
        step *= 2
    return out


def _pack(maps: np.ndarray) -> np.ndarray:
    shifts = np.arange(maps.shape[1], dtype=np.int64) * BITS
    return (maps.astype(np.int64) << shifts).sum(axis=1)


def machine_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], code: str, moves: list[list[int]], start: int, segments: int | None = None) -> DataFrame:
    """Adds ``_before``, the state in which each row finds its group; every group begins in ``start``.

    ``code`` names a BIGINT that packs, for each state, the number of the rule that fires; ``moves[state][rule]`` is the next state. Each segment is
    read once: every row gets the map of all rows before it in its segment, and the segments' maps, applied in order, give the
    state that each segment starts from.
    """
    keys, order = list(keys), list(order)
    n_states = len(moves)
    table = np.zeros((n_states, 1 << BITS), dtype=np.int64)
    for i, row in enumerate(moves):
        table[i, : len(row)] = row
    laid = lay_out(df, keys, order, segments)
    schema = T.StructType([*laid.schema.fields, T.StructField("_pre", T.LongType()), T.StructField("_all", T.LongType())])
    shifts = np.arange(n_states, dtype=np.int64) * BITS

    def run(batches):
        before, carried = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rules = (np.asarray(batch.column(code))[:, None] >> shifts) & ((1 << BITS) - 1)
            starts, last = group_starts(batch, keys, before)
            maps = compose_along(table[np.arange(n_states), rules], starts)
            if not starts[0]:
                # rows of the group that the batch before ended in
                end = int(np.argmax(starts)) if starts.any() else len(starts)
                maps[:end] = maps[:end][:, carried]
            pre = np.empty_like(maps)
            pre[1:] = maps[:-1]
            pre[starts] = np.arange(n_states)
            if not starts[0]:
                pre[0] = carried
            before, carried = last, maps[-1].copy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_pack(pre)), pa.array(_pack(maps))], names=[*batch.schema.names, "_pre", "_all"])

    scanned = materialise(laid.mapInArrow(run, schema))
    by = [*keys, SEG]
    whole = scanned.groupBy(*by).agg(F.max_by("_all", F.struct(*order)).alias("_map"))
    earlier = F.collect_list("_map").over(Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1))
    apply = lambda s, m: apply_map(m, s)
    starts = whole.withColumn("_maps", earlier).select(*by, F.aggregate("_maps", F.lit(start).cast("int"), apply).alias("_start"))
    rows = join_segments(scanned, starts, by)
    return rows.withColumn("_before", apply_map(F.col("_pre"), F.col("_start"))).drop("_pre", "_all", "_start", SEG)


def apply_map(packed: Column, state: Column) -> Column:
    """Value of a packed map (or rule list) for a state."""
    return F.call_function("shiftright", packed, state * BITS).bitwiseAND((1 << BITS) - 1).cast("int")


# --- folds in order ---------------------------------------------------------------------------------------


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], body: Callable, schema: str) -> DataFrame:
    """``body(batches)`` over Arrow batches in which the rows of each group follow each other in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(body, schema)
