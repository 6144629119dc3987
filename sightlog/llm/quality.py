"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics (shares of character classes, lengths, repetition) are standardised and mapped to random Fourier
features, whose inner products approximate a Gaussian kernel. Every partition sums its normal equations, sums of partitions
are added, and the ridge weights solve one small system. On a calibration fold, not used for the fit, scores are counted in
bins and pooled by adjacent violators into an isotonic curve, which maps scores to probabilities.

What reaches the driver has a fixed size: the moments, FEATURES squared sums and BINS counts. All labelled rows are used. Labels,
language, source and id never enter a score; ids only deal rows into folds (crc32 of the id as text modulo 5: 0 held out, 4
calibration, the rest fit).

Defined cases: null and empty texts have the statistics of an empty text and get a score; a null id belongs to no training fold and
is not held out; null, contradicting or missing labels train nothing; without any labels every score is 0.5;
repeated rows give one row each; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import map_batches, query, table
from sightlog.session import materialise

FEATURES, RIDGE, BINS, SEED, WIDTH = 192, 1e-3, 1024, 20, 3.0
FOLDS, CUT = 5, 0.3

#: Byte classes: lower, upper, digit, white space, stop marks, loud marks, other ASCII, beyond ASCII.
CLASS = np.full(256, 6)
CLASS[[*range(97, 123)]], CLASS[[*range(65, 91)]], CLASS[[*range(48, 58)]], CLASS[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3
CLASS[[*b".,;:'-"]], CLASS[[*b"!?"]], CLASS[128:] = 4, 5, 7


def statistics(text: str) -> list[float]:
    """Fixed-length statistics of one text, each of about unit size."""
    raw = text.encode()
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(CLASS, weights=seen, minlength=8) / n
    words = raw.split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    p = seen[seen > 0] / n
    return [
        *shares, float(seen[[*b"#*$%&|<>"]].sum()) / n, float(seen[[*b"|"]].sum()) / k, math.log1p(len(words)) / 5, float(lengths.mean()) / 8, float(lengths.std()) / 8,
        float((lengths <= 3).mean()), float((lengths > 15).mean()), len(set(words)) / k, len(set(lines)) / max(len(lines), 1), math.log1p(k / max(len(lines), 1)) / 4,
        float(-(p * np.log(p)).sum()) / 4, sum(w[:1].isupper() for w in words) / k, sum(w[-1:] in b".!?" for w in words) / k,
    ]


N_STATS = len(statistics(""))


def document_statistics(documents: DataFrame) -> DataFrame:
    def run(ids, texts):
        return [ids, [statistics(t or "") for t in texts]]

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), "doc_id long, stats array<double>", run)


def projection(n_stats: int = N_STATS, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n_stats, features)) / width, rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """Features of standardised statistics; the last one is constant."""
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] + model["b"]
    return np.hstack([np.sqrt(2 / z.shape[1]) * np.cos(z), np.ones((len(x), 1))])


def partition_sums(df: DataFrame, columns: list[str], size: int, summed) -> np.ndarray:
    """Sum of ``summed(*columns)`` (a vector of ``size`` numbers per batch) over all rows.

    Each partition gives one vector; vectors are added in groups by a square-root tree, so neither a task nor the driver gets one for each partition.
    """

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += summed(*(np.asarray(c.to_pylist()) for c in batch.columns))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    def add(batches):
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    parts = df.select(*columns).mapInArrow(run, "v binary")
    middle = parts.repartition(8).mapInArrow(add, "v binary")
    return sum((np.frombuffer(r["v"]) for r in middle.collect()), np.zeros(size))


def pool(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic fit of good / total by pooling adjacent violators; empty bins take the value between their neighbours."""
    blocks: list[list[float]] = []
    where = np.flatnonzero(total)
    for i in where:
        blocks.append([good[i], total[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + t, blocks[-1][2] + n]
    fitted = np.repeat([(g + 0.5) / (t + 1) for g, t, _ in blocks], [int(n) for *_, n in blocks])
    return np.interp(np.arange(len(total)), where, np.maximum.accumulate(fitted))


def train(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS) -> dict | None:
    """The model as a few small arrays, or None without labelled rows."""
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2"))
    known = known.where("y = y2").select("doc_id", "y", (F.crc32(F.col("doc_id").cast("string")) % FOLDS).alias("fold")).where("fold <> 0")
    rows = materialise(stats.join(known, "doc_id").select("stats", F.col("y").cast("double").alias("y"), "fold"))
    n_stats = N_STATS
    moments = partition_sums(rows, ["stats"], 2 * n_stats + 1, lambda x: np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]]))
    n = moments[-1]
    if not n:
        return None
    mean = moments[:n_stats] / n
    model = {"mean": mean, "scale": np.sqrt(np.maximum(moments[n_stats:-1] / n - mean**2, 0)) + 1e-3}
    model["w"], model["b"] = projection(n_stats, features)
    d = features + 1

    def normal(x, y):
        z = fourier(x, model)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    fit = rows.where(F.col("fold") != FOLDS - 1)
    sums = partition_sums(fit, ["stats", "y"], d * d + d, normal)
    gram = sums[: d * d].reshape(d, d)
    model["weights"] = np.linalg.solve(gram + ridge * max(gram[-1, -1], 1.0) * np.eye(d), sums[d * d :])

    def counted(x, y):
        at = score_bins(x, model, bins)
        return np.concatenate([np.bincount(at, weights=y, minlength=bins), np.bincount(at, minlength=bins)])

    hist = partition_sums(rows.where(F.col("fold") == FOLDS - 1), ["stats", "y"], 2 * bins, counted)
    if not hist[bins:].any():
        hist = partition_sums(rows, ["stats", "y"], 2 * bins, counted)
    model["curve"] = pool(hist[:bins], hist[bins:])
    return model


def raw_scores(x: np.ndarray, model: dict) -> np.ndarray:
    return fourier(x, model) @ model["weights"]


def score_bins(x: np.ndarray, model: dict, bins: int) -> np.ndarray:
    return np.clip((raw_scores(x, model) + 0.5) / 2 * bins, 0, bins - 1).astype(int)


def score(stats: DataFrame, model: dict | None, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted. The isotonic curve is followed linearly between bins."""

    def run(ids, rows):
        if not ids:
            return [ids, []]
        if model is None:
            return [ids, [0.5] * len(ids)]
        curve = model["curve"]
        at = np.clip((raw_scores(np.asarray(rows), model) + 0.5) / 2 * len(curve) - 0.5, 0, len(curve) - 1)
        return [ids, np.interp(at, np.arange(len(curve)), curve).tolist()]

    scored = map_batches(stats.select("doc_id", "stats"), "doc_id long, score double", run)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of ``documents``; the statistics (a few numbers per row) are written once and read by each step."""
    stats = materialise(document_statistics(documents))
    return score(stats, train(stats, labels))


@query("op1_quality")
def op1_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
