"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one row with a weight. The rows of a label are dealt by hash into shards of about
``SHARD_ROWS``; every shard builds its graph in one task. Then each pair of shards of a label (a shard with itself included) is one task:
the vectors of either search the graph of the other by beams, and candidates are verified by their cosine in double precision. A
beam that holds links only is widened; an audit of either side compares shuffled queries, block by block until links are seen, with brute force
and doubles all beams until ``RECALL`` of the links is found, at last to the width of the shard, which is a full comparison. Links leave a task as counts and as
one star per connected set, so a dense group is never expanded into pairs; stars of all tasks are united by
distributed components.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components, and rows without label, link with nothing; vectors
of different length are never compared; repeated rows count as other vectors of their class; a row with a null id has
its class's smallest other id as component, or null; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import components, query, table
from sightlog.llm.simhash import FLUSH, stars
from sightlog.session import materialise

COSINE, RECALL = 0.93, 0.995
SHARD_ROWS, DEGREE, BUILD_BEAM, BEAM, AUDIT, BATCH, EXPAND = 8192, 12, 48, 48, 256, 256, 4


class Graph:
    """Layers of neighbour lists over unit vectors; a layer is an array (rows, width) of row numbers, -1 for none."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray] | None = None, seed: int = 1):
        self.x = np.ascontiguousarray(unit, dtype=np.float32)
        n = len(unit)
        # a fixed layout: row i's top layer follows from a seeded draw, row 0 is on all layers and the entry
        draw = np.random.default_rng(seed).random(n)
        self.top = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(int), 6) if n else np.zeros(0, int)
        depth = int(self.top.max(initial=0))
        if n:
            self.top[0] = depth
        self.layers = layers or [np.full((n, 2 * DEGREE if level == 0 else DEGREE), -1, dtype=np.int32) for level in range(depth + 1)]
        if layers is None and n:
            self._build()

    def search(self, q: np.ndarray, level: int, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams of row numbers and similarities (best first) of all queries, expanded in step."""
        b, links = len(q), self.layers[level]
        ids = np.full((b, beam), -1, dtype=np.int64)
        sims = np.full((b, beam), -np.inf, dtype=np.float32)
        done = np.ones((b, beam), dtype=bool)
        seen = np.zeros((b, len(self.x)), dtype=bool)
        width = min(entry.shape[1], beam)
        rows = np.arange(b)[:, None]
        ids[:, :width] = entry[:, :width]
        ok = ids[:, :width] >= 0
        sims[:, :width] = np.where(ok, np.einsum("bed,bd->be", self.x[ids[:, :width]], q), -np.inf)
        done[:, :width] = ~ok
        seen[np.broadcast_to(rows, ok.shape)[ok], ids[:, :width][ok]] = True
        live, expand = np.arange(b), max(EXPAND, beam // 8)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            take = np.argsort(-open_sims, axis=1, kind="stable")[:, :expand]
            good = np.take_along_axis(open_sims, take, 1) > -np.inf
            some = good.any(1)
            live, take, good = live[some], take[some], good[some]
            if not len(live):
                break
            at = live[:, None]
            done[at, take] = True
            near = np.where(good[:, :, None], links[ids[at, take]], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & ~seen[at, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[np.broadcast_to(at, near.shape)[fresh], near[fresh]] = True
            wide = int(fresh.sum(1).max())
            if not wide:
                continue
            pick = np.argsort(~fresh, axis=1, kind="stable")[:, :wide]
            near, fresh = np.take_along_axis(near, pick, 1), np.take_along_axis(fresh, pick, 1)
            new = np.where(fresh, np.einsum("bed,bd->be", self.x[near], q[live]), -np.inf)
            all_sims = np.concatenate([sims[live], new.astype(np.float32)], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
        return ids, sims

    def descend(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), dtype=np.int64)
        for level in range(len(self.layers) - 1, 0, -1):
            entry, _ = self.search(q, level, entry, 4)
        return self.search(q, 0, entry, beam)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Neighbours nearer to the row than to any neighbour already chosen; free places go to the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        vectors = self.x[ids]
        between = np.einsum("bed,bfd->bef", vectors, vectors)
        valid = sims > -np.inf
        chosen = np.zeros(ids.shape, dtype=bool)
        for c in range(ids.shape[1]):
            closest = np.where(chosen, between[:, c], -np.inf).max(1)
            chosen[:, c] = valid[:, c] & (sims[:, c] > closest) & (chosen.sum(1) < width)
        rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def _build(self) -> None:
        n, at = len(self.x), 1
        while at < n:
            batch = np.arange(at, min(n, at + min(at, BATCH)))
            q = self.x[batch]
            inner = q @ q.T
            np.fill_diagonal(inner, -np.inf)
            entry = np.zeros((len(batch), 1), dtype=np.int64)
            for level in range(len(self.layers) - 1, -1, -1):
                member = self.top[batch] >= level
                entry, sims = self.search(q, level, entry, BUILD_BEAM if member.any() else 4)
                if member.any():
                    own = batch[member]
                    peers = inner[np.ix_(member, member)]
                    nearest = np.argsort(-peers, axis=1, kind="stable")[:, : 2 * DEGREE]
                    ids = np.concatenate([entry[member], own[nearest]], axis=1)
                    both = np.concatenate([sims[member], np.take_along_axis(peers, nearest, 1)], axis=1)
                    both[ids < 0] = -np.inf
                    self._link(level, own, ids, both)
            at = batch[-1] + 1

    def _link(self, level: int, own: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        layer = self.layers[level]
        width = layer.shape[1]
        layer[own] = self._diverse(ids, sims, width)
        source, target = np.repeat(own, width), layer[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):  # some incoming links per row at a time
            nth = np.arange(len(target)) - np.searchsorted(target, target)
            now = nth < DEGREE
            rows, slot = np.unique(target[now], return_inverse=True)
            incoming = np.full((len(rows), DEGREE), -1, dtype=np.int64)
            incoming[slot, nth[now]] = source[now]
            old = layer[rows].astype(np.int64)
            incoming[(incoming[:, :, None] == old[:, None, :]).any(2)] = -1
            ids2 = np.concatenate([old, incoming], axis=1)
            sims2 = np.where(ids2 >= 0, np.einsum("bed,bd->be", self.x[ids2], self.x[rows]), -np.inf)
            layer[rows] = self._diverse(ids2, sims2, width)
            source, target = source[~now], target[~now]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def beam_links(q: np.ndarray, x: np.ndarray, graph: Graph, beam: int, cosine: float) -> np.ndarray:
    """Links (queries x vectors, boolean) that beams of at least ``beam`` find; a beam of nothing but links is widened."""
    n = len(x)
    hits = np.zeros((len(q), n), dtype=bool)
    for at in range(0, len(q), BATCH):
        rows = np.arange(at, min(at + BATCH, len(q)))
        width = beam
        while len(rows):
            if width >= n:
                hits[rows] |= q[rows] @ x.T >= cosine
                break
            ids, _ = graph.descend(q[rows].astype(np.float32), width)
            exact = np.where(ids >= 0, np.einsum("bed,bd->be", x[ids], q[rows]), -1.0)
            near = exact >= cosine
            hits[np.broadcast_to(rows[:, None], ids.shape)[near], ids[near]] = True
            rows = rows[near.all(1)]
            width *= 4
    return hits


def audit_links(q: np.ndarray, x: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``q`` in a shuffled order, block by block until one has a link, and their true links. If none has, all rows were compared."""
    order = np.random.default_rng(1).permutation(len(q))
    for at in range(0, len(q), AUDIT):
        rows = order[at : at + AUDIT]
        truth = q[rows] @ x.T >= cosine
        if same:
            truth[np.arange(len(rows)), rows] = False
        if truth.any():
            return rows, truth
    return order[:0], np.zeros((0, len(x)), dtype=bool)


def found_links(a: np.ndarray, graph_a: Graph, b: np.ndarray, graph_b: Graph, cosine: float = COSINE, recall: float = RECALL) -> np.ndarray:
    """Links between two sets of vectors (or within one, if both are the same): either side searches the other's graph, so a row that
    one graph hardly reaches is found from its own query. Beams grow until the audits of both sides pass; each audited row counts alike, so
    a dense group does not hide what lone pairs miss."""
    same = a is b
    a, b = unit_rows(a), unit_rows(b)
    rows_a, truth_a = audit_links(a, b, cosine, same)
    rows_b, truth_b = (rows_a[:0], truth_a[:0]) if same or not len(rows_a) else audit_links(b, a, cosine, same)
    if not len(rows_a):  # every row of a was compared with all of b
        return np.eye(len(a), dtype=bool) if same else np.zeros((len(a), len(b)), dtype=bool)
    beam, widest = BEAM, max(len(a), len(b))
    while True:
        hits = beam_links(a, b, graph_b, beam, cosine)
        hits |= hits.T if same else beam_links(b, a, graph_a, beam, cosine).T
        shares = [
            (seen & truth).sum(1)[linked] / truth.sum(1)[linked]
            for seen, truth in ((hits[rows_a], truth_a), (hits.T[rows_b], truth_b)) if len(truth) for linked in [truth.any(1)]
        ]
        if beam >= widest or min(share.mean() for share in shares) >= recall:
            return hits
        beam *= 2


def link_counts(hits: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray):
    """Links of the rows of both sides and the stars of connected rows; blocks bound the numbers and the edges held at once."""
    counts_a, counts_b = np.zeros(len(own_a), np.int64), np.zeros(len(own_b), np.int64)
    stars_a, stars_b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    step = max(1, FLUSH // max(hits.shape[1], 1))
    for at in range(0, len(hits), step):
        part = hits[at : at + step]
        counts_a[at : at + step] = part @ weight_b
        counts_b += weight_a[at : at + step] @ part
        i, j = np.nonzero(part)
        stars_a.append(own_a[at + i])
        stars_b.append(own_b[j])
        held += len(i)
        if held > FLUSH:
            a, b = stars(np.concatenate(stars_a), np.concatenate(stars_b))
            stars_a, stars_b, held = [a], [b], 0
    a, b = stars(np.concatenate(stars_a), np.concatenate(stars_b))
    return counts_a, counts_b, a, b


GRAPH_ROW = "label int, dim int, shard int, shards int, no int, first long, weight long, vec array<double>, layers array<array<int>>"


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("order", kind="stable").reset_index(drop=True)
    graph = Graph(unit_rows(np.array(rows["vec"].tolist(), dtype=np.float64)))
    out = rows[["label", "dim", "shard", "shards", "first", "weight", "vec"]].copy()
    out["no"] = np.arange(len(rows), dtype=np.int32)
    out["layers"] = [[layer[i].tolist() for layer in graph.layers] for i in range(len(rows))]
    return out[["label", "dim", "shard", "shards", "no", "first", "weight", "vec", "layers"]]


def _restore(rows: pd.DataFrame):
    rows = rows.sort_values("no")
    vectors = np.array(rows["vec"].tolist(), dtype=np.float64)
    stacked = [np.array([np.asarray(row[level]) for row in rows["layers"]], dtype=np.int32) for level in range(len(rows["layers"].iloc[0]))]
    return rows["uid"].to_numpy(), rows["weight"].to_numpy(), vectors, Graph(unit_rows(vectors), stacked)


def _pair_task(cosine: float, recall: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [_restore(side) for _, side in rows.groupby("shard", sort=True)]
        none = np.empty(0, np.int64)
        if len(sides) == 1:
            uid, weight, vectors, graph = sides[0]
            if rows["lo"].iloc[0] != rows["hi"].iloc[0]:  # the other shard is empty
                return pd.DataFrame({"uid": none, "n": none, "root": none})
            hits = found_links(vectors, graph, vectors, graph, cosine, recall)
            np.fill_diagonal(hits, False)
            counts, _, a, b = link_counts(hits, uid, uid, weight, weight)
            parts = [(uid, counts)]
        else:
            (uid_a, weight_a, va, ga), (uid_b, weight_b, vb, gb) = sides
            hits = found_links(va, ga, vb, gb, cosine, recall)
            counts_a, counts_b, a, b = link_counts(hits, uid_a, uid_b, weight_a, weight_b)
            parts = [(uid_a, counts_a), (uid_b, counts_b)]
        root = dict(zip(a.tolist(), b.tolist(), strict=True))
        uids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"uid": uids, "n": counts.astype(np.int64), "root": [root.get(u, u) for u in uids.tolist()]})

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``embeddings``."""
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>").alias("vec")
    )
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("vec", F.when(usable, F.col("vec"))).withColumn("label", F.when(usable, F.col("label")))
    distinct = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    distinct = distinct.withColumns({"dim": F.size("vec"), "order": F.xxhash64("vec")})
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = distinct.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.shiftright("order", 20), "shards").cast("int"))
    built = dealt.groupBy("label", "dim", "shard").applyInPandas(_build_shard, GRAPH_ROW)
    graphs = materialise(built.withColumn("uid", F.monotonically_increasing_id()))
    pairs = graphs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumns(
        {"lo": F.least("shard", "other"), "hi": F.greatest("shard", "other")}
    )
    found = materialise(pairs.drop("other").groupBy("label", "dim", "lo", "hi").applyInPandas(_pair_task(cosine, recall), "uid long, n long, root long"))
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = graphs.select("uid", "label", "vec", "first", "weight").join(counts, "uid").join(roots.withColumnRenamed("id", "uid"), "uid", "left")
    named = named.withColumn("root", F.coalesce("root", "uid"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    classes = named.join(lowest, "root").select("label", "vec", (F.col("n") + F.col("weight") - 1).alias("n"), "component")
    return rows.join(classes, ["label", "vec"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op4_vector_graph")
def op4_vector_graph(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
