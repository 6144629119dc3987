"""Train/validation splits and rank selection without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlog.session import materialise

LEVELS = (3, 8)  # hex digits of the hash; eight leave one row in four billion to a range


def hash_key(seed: int | str, *cols: str) -> Column:
    """A shuffled order that any engine can repeat: md5 over seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def validation_size(n: Column, ratio: float) -> Column:
    """max(1, int(n * ratio)), none for an empty set and none for ratio 0."""
    if ratio <= 0:
        return F.lit(0).cast("bigint")
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio))))).otherwise(0).cast("bigint")


def lowest_by_hash(
    df: DataFrame, strata: Sequence[str], key_cols: Sequence[str], seed, take: Column, name: str
) -> DataFrame:
    """Mark the ``take`` rows with the smallest hash in each stratum (``take`` may use ``n``).

    Radix selection in fixed levels: rows are counted per hash prefix, and only the rows of the prefix in which the cumulated
    count reaches ``take`` go on to the next, longer prefix; the few that are left are ranked. That gives one cut per
    stratum, and a last pass compares each row with it. Rows with equal keys stay together.
    """
    strata = list(strata)
    h = df.withColumn("_h", hash_key(seed, *key_cols))
    place = F.struct("_h", *key_cols)
    rows, wanted = h.select(*strata, "_h", *[c for c in key_cols if c not in strata]), None
    w = Window.partitionBy(*strata).orderBy("_b")
    for digits in LEVELS:
        rows = rows.withColumn("_b", F.substring("_h", 1, digits))
        if wanted is None:
            counts = rows.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
            counts = counts.withColumn("n", F.sum("_c").over(Window.partitionBy(*strata))).withColumn("_take", take)
        else:
            counts = rows.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first("_left").alias("_take"))
        before = F.sum("_c").over(w) - F.col("_c")
        wanted = counts.select(*strata, "_b", (F.col("_take") - before).alias("_left"), "_c").filter("_left > 0 AND _left <= _c")
        # one prefix of a stratum in thousands is left: stored, so that the next level does not read and hash the whole table again
        rows = materialise(rows.drop("_left").join(wanted.drop("_c"), strata + ["_b"]))
    rank = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy(place))
    cut = rows.withColumn("_rank", rank).filter("_rank = _left").select(*strata, place.alias("_cut"))
    marked = h.join(cut, strata, "left") if strata else h.crossJoin(cut.agg(F.first("_cut").alias("_cut")))
    return marked.withColumn(name, F.coalesce(place <= F.col("_cut"), F.lit(False))).drop("_h", "_cut")


def split_whole(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Shuffled split of the whole set; adds ``is_val``."""
    return lowest_by_hash(df, [], [key], seed, validation_size(F.col("n"), ratio), "is_val")


def split_per_group(df: DataFrame, group: Sequence[str], key_cols: Sequence[str], ratio: float, seed: int = 42):
    """Stratified split: a group of one row stays in training."""
    n = F.col("n")
    take = F.when(n > 1, F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio))))).otherwise(0).cast("bigint")
    return lowest_by_hash(df, list(group), list(key_cols), seed, take, "is_val")
