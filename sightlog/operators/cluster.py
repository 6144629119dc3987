"""Clusters of frame vectors: assignment, centroids, representatives, label propagation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlog.session import materialise

#: Fixed point of one in the vectors that are clustered.
ONE = 1_000_000


def l2_normalised(v: Column, floor: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(floor)))


def fixed_units(v: Column) -> Column:
    """L2-normalised vector in fixed point; a vector without length stays at zero."""
    whole = F.transform(v, lambda x: F.round(x.cast("double") * ONE).cast("bigint"))
    square = F.aggregate(whole, F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    norm = F.greatest(F.sqrt(square.cast("double")), F.lit(1.0))
    return F.transform(whole, lambda x: F.round(x.cast("double") * float(ONE) / norm).cast("bigint"))


def assign_clusters(vectors: DataFrame, key: str, vector: str, k: int, dim: int, rounds: int = 20) -> DataFrame:
    """Lloyd's k-means on L2-normalised vectors; adds ``cluster``.

    It starts from the ``k`` vectors with the smallest keys and ends when no centre moves, or after ``rounds`` rounds. Vectors and centres are whole
    numbers and sums are exact, so the result depends neither on the order of rows nor on their partitions. A round sums per task before
    the shuffle; the driver holds ``k`` centres. A vector that is null or not of ``dim`` finite numbers is left out.
    """
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    good = vectors.filter((F.size(vector) == dim) & finite)
    units = materialise(good.withColumn("_u", fixed_units(F.col(vector))))
    centres = np.array([r["_u"] for r in units.orderBy(key).select("_u").limit(k).collect()], dtype=np.int64).reshape(-1, dim)
    if not len(centres):
        return units.withColumn("cluster", F.lit(None).cast("int")).drop("_u")
    for _ in range(rounds):
        before = centres
        parts = units.select("_u").mapInArrow(_partial_sums(centres), "cluster int, at int, n long")
        moved = centres.copy()
        sums = {(r["cluster"], r["at"]): r["n"] for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n")).collect()}
        for c, at in sums:
            if at >= 0:
                moved[c, at] = sums[c, at] // sums[c, -1]
        centres = moved
        if (centres == before).all():
            break
    names = units.columns[:-1]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*names).schema.fields), "cluster int"])

    def run(batches):
        for batch in batches:
            near = pa.array(_nearest(batch.column("_u"), centres).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), near], names=[*names, "cluster"])

    return units.mapInArrow(run, schema)


def _nearest(units: pa.ListArray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each vector, the first of equals. All values are whole and below 2**53, so doubles hold them exactly."""
    u = np.asarray(units.flatten()).reshape(len(units), centres.shape[1]).astype(np.float64)
    c = centres.astype(np.float64)
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * (u @ c.T), axis=1)


def _partial_sums(centres: np.ndarray):
    def run(batches):
        k, dim = centres.shape
        sums, counts = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            column = batch.column("_u")
            if len(column):
                near = _nearest(column, centres)
                u = np.asarray(column.flatten()).reshape(-1, dim)
                for c in np.unique(near):
                    sums[c] += u[near == c].sum(axis=0)
                    counts[c] += (near == c).sum()
        found = np.flatnonzero(counts)
        rows = [(int(c), at, int(n)) for c in found for at, n in [(-1, counts[c]), *enumerate(sums[c])]]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["cluster", "at", "n"])

    return run


def centroids(members: DataFrame, cluster: str, vector: str, dim: int) -> DataFrame:
    """Mean of the raw vectors per cluster: one partial sum per dimension and task, no exploding."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim)]
    wide = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *means)
    return wide.select(cluster, "size", F.array(*[f"m{i}" for i in range(dim)]).alias("centroid"))


def representatives(members: DataFrame, cluster: str, key: str, vector: str, dim: int, list_size: int = 50) -> DataFrame:
    """Per cluster: size, the member closest to the centroid and the first members by key.

    How the centroids meet their members is left to the optimiser, which knows their size.
    """
    c = centroids(members, cluster, vector, dim)
    sq = F.aggregate(
        F.zip_with(vector, "centroid", lambda a, b: a.cast("double") - b), F.lit(0.0), lambda s, d: s + d * d
    )
    # eight decimals make the choice independent of the order of partial sums
    near = members.join(c, cluster).select(cluster, key, "size", F.round(F.sqrt(sq), 8).alias("d"))
    best = near.groupBy(cluster).agg(F.first("size").alias("size"), F.min_by(key, F.struct("d", key)).alias("representative"))
    rn = F.row_number().over(Window.partitionBy(cluster).orderBy(key))
    first = members.select(cluster, key).withColumn("_rn", rn).filter(F.col("_rn") <= list_size)
    listed = first.groupBy(cluster).agg(F.array_sort(F.collect_list(key)).alias("members"))
    return best.join(listed, cluster)


def propagate_labels(members: DataFrame, labelled: DataFrame, cluster: str) -> DataFrame:
    """Label of each cluster's representative to all its members."""
    return members.join(labelled, cluster, "left")
