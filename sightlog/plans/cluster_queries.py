"""Queries on frame vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlog.operators import cluster as cl
from sightlog.operators import labels as lb
from sightlog.plans.registry import query
from sightlog.sources import tables as src

DIM = 64


@query(
    "fn17_l2_normalised",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 6) AS total FROM (
SELECT vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-8) AS n FROM embeddings)""",
)
def l2_normalised(spark, sf):
    v = src.table(spark, sf, "embeddings").select("vec_id", cl.l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


CENTRE = f"""m AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings),
c AS (SELECT label, i, avg(x) AS mean FROM m GROUP BY ALL),
d AS (SELECT m.label, vec_id, round(sqrt(sum((x - mean) * (x - mean))), 8) AS d FROM m JOIN c USING (label, i) GROUP BY ALL),
rep AS (SELECT label AS cluster, CAST(count(*) AS BIGINT) AS size, arg_min(vec_id, ROW(d, vec_id)) AS representative FROM d GROUP BY label)"""


@query(
    "ag19_cluster_representatives",
    f"""WITH {CENTRE} SELECT rep.*, (SELECT list(vec_id ORDER BY vec_id)[1:50] FROM embeddings e WHERE e.label = rep.cluster) AS members FROM rep""",
)
def cluster_representatives(spark, sf):
    v = src.table(spark, sf, "embeddings").withColumnRenamed("label", "cluster")
    return cl.representatives(v, "cluster", "vec_id", "embedding", DIM)


K, ROUNDS = 10, 6
# Lloyd's rounds written out one after the other; sums are shifted so that a whole division rounds down for either sign
LLOYD = f"""q AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)) AS w FROM embeddings),
u AS (SELECT vec_id, embedding, list_transform(w, lambda x: CAST(round(x::DOUBLE * 1000000::DOUBLE / greatest(sqrt(CAST(list_sum(list_transform(w, lambda y: y * y)) AS BIGINT)::DOUBLE), 1)) AS BIGINT)) AS u FROM q),
k0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS cluster, u AS c FROM u ORDER BY vec_id LIMIT {K})""" + "".join(
    f""",
a{r} AS (SELECT vec_id, arg_min(cluster, ROW(CAST(list_sum(list_transform(list_zip(u, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), cluster)) AS cluster FROM u, k{r} GROUP BY vec_id),
k{r + 1} AS (SELECT k{r}.cluster, coalesce(n.c, k{r}.c) AS c FROM k{r} LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS c FROM (
  SELECT cluster, i, CAST((sum(x) + 4000000 * count(*)) // count(*) AS BIGINT) - 4000000 AS m FROM (SELECT a.cluster, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u JOIN a{r} a USING (vec_id)) GROUP BY cluster, i) GROUP BY cluster) n USING (cluster))"""
    for r in range(ROUNDS)
)


@query(
    "ag19_kmeans_clusters",
    f"""WITH {LLOYD}, last AS (SELECT vec_id, arg_min(cluster, ROW(CAST(list_sum(list_transform(list_zip(u, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), cluster)) AS cluster FROM u, k{ROUNDS} GROUP BY vec_id),
e AS (SELECT e.vec_id, e.embedding, last.cluster FROM embeddings e JOIN last USING (vec_id)),
m AS (SELECT cluster, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM e),
c AS (SELECT cluster, i, avg(x) AS mean FROM m GROUP BY ALL),
d AS (SELECT m.cluster, vec_id, round(sqrt(sum((x - mean) * (x - mean))), 8) AS d FROM m JOIN c USING (cluster, i) GROUP BY ALL),
rep AS (SELECT cluster, CAST(count(*) AS BIGINT) AS size, arg_min(vec_id, ROW(d, vec_id)) AS representative FROM d GROUP BY cluster)
SELECT rep.*, (SELECT list(vec_id ORDER BY vec_id)[1:50] FROM e WHERE e.cluster = rep.cluster) AS members FROM rep""",
)
def kmeans_clusters(spark, sf):
    v = src.table(spark, sf, "embeddings").select("vec_id", "embedding")
    a = cl.assign_clusters(v, "vec_id", "embedding", K, DIM, ROUNDS)
    return cl.representatives(a, "cluster", "vec_id", "embedding", DIM)


@query(
    "jo18_label_propagation",
    f"WITH {CENTRE} SELECT e.vec_id, rep.representative % 6 AS state_id FROM embeddings e JOIN rep ON rep.cluster = e.label",
)
def label_propagation(spark, sf):
    v = src.table(spark, sf, "embeddings").withColumnRenamed("label", "cluster")
    reps = cl.representatives(v, "cluster", "vec_id", "embedding", DIM)
    named = reps.select("cluster", (F.col("representative") % 6).alias("state_id"))
    return cl.propagate_labels(v.select("vec_id", "cluster"), named, "cluster").select("vec_id", "state_id")
