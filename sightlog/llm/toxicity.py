"""Toxicity by multiple-instance learning: sentences are the instances, a noisy-or joins them, only documents have labels.

A sentence is a run without ``.!?`` and line ends; its features are its lower-cased words and their first four, five and six characters (families of
made-up spellings share a stem), hashed into BUCKETS. A sentence has the probability p = sigmoid(bias + sum of its distinct
features' weights) and a document 1 - prod(1 - p): one offending sentence is enough, however long the text. With A = sum softplus(z) the document's
probability is 1 - exp(-A), so the gradient of the document's log loss reaches each sentence in closed form, and labels of
documents teach weights of sentences. The trained model then scores every sentence, which locates the offending ones.

Training reads at most TRAIN_ROWS labelled rows (the smallest hashes of their ids, a documented bound; any size behaves alike). Features are screened by
a likelihood ratio over documents; each step sums gradients by partition, and sums are added over partitions in tasks. The driver holds vectors of BUCKETS or
FEATURES numbers. Labels, language, source and id never enter a score; ids only deal rows into folds (crc32 of the id as text modulo 5: 0 held out).

Defined cases: null and empty texts have no sentence and get the score of a text without any feature, 1 - exp(-softplus(bias)); a null id is
not held out and trains nothing; null or contradicting labels train nothing; a document whose rows have one id trains with
each of them; without labels of both kinds every score is the share of toxic labels (0.5 without any); repeated rows give
one row each; further columns are not read. Work on a text grows with its length only.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm.common import map_batches, query, table
from sightlog.session import materialise, scratch_path

TRAIN_ROWS, BUCKETS, FEATURES, LEAST_DOCUMENTS = 20_000, 1 << 18, 4096, 3
STEPS, RATE, RIDGE, FOLDS, CUT = 40, 0.4, 1e-5, 5, 0.5
STEMS = (4, 5, 6)
#: Words kept per task with their features; a full memory is emptied.
MEMORY = 300_000

SENTENCE = re.compile(r"[^.!?\n\r]+")
WORD = re.compile(r"\w+")


def features_of(word: str) -> list[int]:
    """Buckets of a lower-cased word and of its stems."""
    raw = {b"=" + word.encode("utf-8", "replace")} | {b"^" + word[:k].encode("utf-8", "replace") for k in STEMS if len(word) >= k}
    return [zlib.crc32(r) % BUCKETS for r in raw]


class Memory(dict):
    """``make(word)`` for each word seen, up to MEMORY words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = self.make(word)
        return found


def _summed(df: DataFrame, size: int, vectors) -> np.ndarray:
    """Sum of the vectors that ``vectors(batch)`` gives, over all batches: one row per slice of a partition's sum, added per slice by the shuffle's tasks."""
    width = 4096

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += vectors(batch)
        parts = [(i, total[i : i + width]) for i in range(0, size, width)]
        parts = [(i, p.tobytes()) for i, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([p for _, p in parts], pa.binary())], names=["at", "v"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[i] = held[i] + np.frombuffer(v) if i in held else np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["at", "v"])

    total = np.zeros(size)
    for row in df.mapInArrow(run, "at long, v binary").repartition("at").mapInArrow(add, "at long, v binary").collect():
        total[row["at"] : row["at"] + len(row["v"]) // 8] += np.frombuffer(row["v"])
    return total


def training_rows(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """text, y of at most about ``bound`` labelled rows that are not held out: those with the smallest hash of the id."""
    known = labels.where("toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2"))
    known = known.where("y = y2").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).select("doc_id", "y")
    share = 1 << 20
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(share)))
    # the cut of the hash that leaves the bound, from counts in a fixed number of bins
    bins = known.groupBy((F.col("h") / 1024).cast("int").alias("bin")).count().collect()
    kept, cut = 0, share
    for row in sorted(bins):
        if kept and kept + row["count"] > bound:
            cut = row["bin"] * 1024
            break
        kept += row["count"]
    # at most about ``bound`` ids and labels go to every task, so no text is shuffled
    chosen = F.broadcast(known.where(F.col("h") < cut).select("doc_id", F.col("y").cast("int").alias("y")))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("text", "y")


def screen(rows: DataFrame, features: int = FEATURES) -> tuple[np.ndarray, float, float]:
    """The buckets with the highest likelihood ratio between toxic and other documents, and how many rows of either kind there are."""

    def counts(batch):
        memory, seen = Memory(features_of), np.zeros(2 * BUCKETS + 2)
        for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = {b for w in set(WORD.findall((text or "").lower())) for b in memory[w]}
            seen[np.fromiter(found, dtype=np.int64, count=len(found)) + y * BUCKETS] += 1
            seen[2 * BUCKETS + y] += 1
        return seen

    total = _summed(rows, 2 * BUCKETS + 2, counts)
    other, toxic, n0, n1 = total[:BUCKETS], total[BUCKETS:-2], total[-2], total[-1]
    if not n0 or not n1:
        return np.zeros(0, dtype=np.int64), n0, n1

    def part(k, n, rate):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * rate)), 0) + np.where(n > k, (n - k) * np.log((n - k) / np.maximum(n * (1 - rate), 1e-300)), 0)

    rate = (other + toxic) / (n0 + n1)
    ratio = np.where(other + toxic >= LEAST_DOCUMENTS, part(other, n0, rate) + part(toxic, n1, rate), 0)
    order = np.lexsort((np.arange(BUCKETS), -ratio))[:features]
    return np.sort(order[ratio[order] > 1.0]), n0, n1


def instances(rows: DataFrame, buckets: np.ndarray) -> DataFrame:
    """One row per document: label, number of sentences, and the places (in ``buckets``) of each sentence's distinct features."""
    where = {int(b): i for i, b in enumerate(buckets)}

    def run(texts, ys):
        memory = Memory(lambda w: [where[b] for b in features_of(w) if b in where])
        sizes, feats, ends = [], [], []
        for text in texts:
            n, flat, last = 0, [], []
            for sentence in SENTENCE.findall((text or "").lower()):
                words = set(WORD.findall(sentence))
                n += bool(words)
                found = sorted({f for w in words for f in memory[w]})
                if found:
                    flat += found
                    last.append(len(flat))
            sizes.append(n)
            feats.append(flat)
            ends.append(last)
        return [ys, sizes, feats, ends]

    return map_batches(rows.select("text", "y"), "y int, n int, feats array<int>, ends array<int>", run)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists, without a Python object for each."""
    return np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))


def loss_and_gradient(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    """Gradient by weight (the bias last), then the log loss, of documents as ``instances`` gives them."""
    k, (flat, _), (ends, n_ends) = len(weights) - 1, _lists(batch.column("feats")), _lists(batch.column("ends"))
    y, sizes = np.asarray(batch.column("y")), np.asarray(batch.column("n"))
    doc = np.repeat(np.arange(len(y)), n_ends)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    counts = np.where(first, ends, np.diff(ends, prepend=0))
    sentence = np.repeat(np.arange(len(counts)), counts)
    bare = np.maximum(sizes, 1) - n_ends
    z = np.bincount(sentence, weights=weights[flat], minlength=len(counts)) + weights[-1]
    a = np.maximum(np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y)) + bare * np.logaddexp(0, weights[-1]), 1e-12)
    slope = np.where(y == 1, -1 / np.expm1(np.minimum(a, 500)), 1.0)
    dz = slope[doc] / (1 + np.exp(-z))
    grad = np.bincount(flat, weights=dz[sentence], minlength=k)
    bias = dz.sum() + (slope * bare).sum() / (1 + np.exp(-weights[-1]))
    loss = np.where(y == 1, -np.log(-np.expm1(-a)), a).sum()
    return np.concatenate([grad, [bias, loss]])


def train(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, features: int = FEATURES, steps: int = STEPS) -> dict:
    """Weights by bucket and the bias: full gradients with a step of its own for each weight (Adam), from the rate of toxic labels."""
    path = scratch_path(documents.sparkSession, "toxicity-training")
    training_rows(documents, labels, bound).write.parquet(path)
    rows = documents.sparkSession.read.parquet(path)
    buckets, n0, n1 = screen(rows, features)
    model = {"buckets": buckets, "weights": np.zeros(len(buckets)), "bias": 0.0, "constant": None}
    if not n0 or not n1:
        return model | {"constant": float(n1 / (n0 + n1)) if n0 + n1 else 0.5}
    data = materialise(instances(rows, buckets))
    sentences = max(data.agg(F.avg(F.greatest("n", F.lit(1)))).first()[0], 1.0)
    k = len(buckets)
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[-1] = np.log(n1 / (n0 + n1) / sentences)
    for t in range(1, steps + 1):

        def gradient(batch, weights=w.copy()):
            return loss_and_gradient(batch, weights)

        grad = _summed(data, k + 2, gradient)[:-1] / (n0 + n1)
        grad[:-1] += RIDGE * w[:-1]
        first, second = 0.8 * first + 0.2 * grad, 0.95 * second + 0.05 * grad**2
        rate = RATE * min(1.0, 2 * (1 - (t - 1) / steps))
        w = w - rate * (first / (1 - 0.8**t)) / (np.sqrt(second / (1 - 0.95**t)) + 1e-7)
    return model | {"weights": w[:-1], "bias": float(w[-1])}


def score(documents: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences and the offending sentences (p >= cut; start and end in characters of the text)."""
    constant, bias = model["constant"], model["bias"]
    weight = dict(zip(model["buckets"].tolist(), model["weights"].tolist(), strict=True))
    schema = "doc_id long, score double, n_sentences long, starts array<int>, ends array<int>, probabilities array<double>"

    def run(ids, texts):
        # words without a known feature add nothing: most sentences need no sum
        memory = Memory(lambda w: {b: weight[b] for b in features_of(w) if b in weight})
        empty = float(np.logaddexp(0, bias))
        edge = np.log(cut / (1 - cut))
        out = [[], [], [], [], []]
        for text in texts:
            a, n, starts, ends, probabilities = 0.0, 0, [], [], []
            text = text or ""
            for m in SENTENCE.finditer(text):
                words = WORD.findall(m.group().lower())
                if not words:
                    continue
                n += 1
                found: dict[int, float] = {}
                for w in words:
                    known = memory[w]
                    if known:
                        found.update(known)
                if not found:
                    a += empty
                    continue
                z = bias + sum(found[b] for b in sorted(found))
                a += float(np.logaddexp(0, z))
                if z >= edge:
                    starts.append(m.start())
                    ends.append(m.end())
                    probabilities.append(float(1 / (1 + np.exp(-z))))
            if not n:
                a = empty
            for column, v in zip(out, (constant if constant is not None else float(-np.expm1(-a)), n, starts, ends, probabilities), strict=True):
                column.append(v)
        return [ids, *out]

    scored = map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, run)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    spans = F.transform(F.arrays_zip("starts", "ends", "probabilities"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"), x["probabilities"].alias("p")))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_sentences", spans.alias("offending"))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    """Of the spans, the query gives how many there are and the first one's place."""
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    first = F.get("offending", F.lit(0))
    return scored.select(
        "doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"),
        first["start"].alias("first_start"), first["end"].alias("first_end"),
    )
