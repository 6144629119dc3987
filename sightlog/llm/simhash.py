"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. If two fingerprints differ in at most four bits,
the two segments with the fewest errors have at most two errors together, so both segments share a codeword index
(see ``golay``). The keys of a fingerprint are therefore the pairs of indices of two segments: about 84 keys of 24 bits, and no link
is lost. Distinct fingerprints are joined on the keys, verified by their Hamming distance, and connected components are
formed over them; documents find their component by their fingerprint.

Copies meet before the join, as equal fingerprints are one row. Rows of a key are compared in arrays inside the task that has them
and leave it as one star per connected set, never as pairs. A key with more than ``HOT`` fingerprints is not compared there: its rows are
dealt to blocks by a hash, and each pair of blocks is a task's group of its own, so all pairs still meet.

Defined cases: null texts count as empty, texts without words have fingerprint zero and link like any other; repeated rows give
one row each; null ids never name a component unless it has no other (then null); further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm import golay
from sightlog.llm.common import components, map_batches, query, table
from sightlog.session import materialise

WORDS, SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
FLUSH = 1_000_000
#: Fingerprints of a key, or of a block of it, that one task compares.
HOT = 16_384


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit integer."""
    return _majority(text, words, seed, 1)[0]


def _majority(text: str, words: int, seed: int, n_words: int) -> list[int]:
    """The fingerprint, and further words of 64 bits from other mixtures of the same shingle hashes."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return [0] * n_words
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(tokens) - words + 1, 1)
    cut = zip(starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist(), strict=True)
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in cut], dtype=np.uint64)
    out = []
    for no in range(n_words):
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 65_536):
            part = _mixed(h[at : at + 65_536]) if no else h[at : at + 65_536]
            total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0]))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other bits of the same hashes: a multiplication by odd constants with shifts between."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(documents: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) per row."""

    def run(ids, texts):
        return [ids, [fingerprint(t or "", words, seed) for t in texts]]

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", run)


def key_rows(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned 64-bit values, and the place of the value that each belongs to."""
    found = [golay.indices(((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    keys, places = [], []
    for no, (i, j) in enumerate(PAIRS):
        a, b = found[i][:, :, None], found[j][:, None, :]
        key = (no << 24) | (a << 12) | b
        at = np.nonzero((a >= 0) & (b >= 0))
        keys.append(key[at])
        places.append(at[0])
    return np.concatenate(keys), np.concatenate(places)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) rows of all keys."""
    keys, places = key_rows(fps.view(np.uint64))
    return keys, fps[places]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected sets of the edges (a, b) as edges from each member to its smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            break
        root = low
    own = root != np.arange(len(ids))
    return ids[own], ids[root[own]]


def links_in_order(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, more: np.ndarray | None = None):
    """Pairs of neighbours in runs of equal keys that are close enough, in blocks of bounded size. ``more`` are second words, which have to
    be as close."""
    at = np.arange(len(keys) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        near = at[np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)) <= distance]
        if more is not None:
            near = near[np.bitwise_count((more[near] ^ more[near + step]).view(np.uint64)) <= distance]
        if len(near):
            yield fps[near], fps[near + step]
        step += 1


def _verify(distance: int, hot: int | None):
    """(key, a, b): stars of close fingerprints, with a null key; of a key with more than ``hot`` rows, the rows (key, fp, null) instead."""

    def run(batches):
        kept_a, kept_b, held = [], [], 0
        rest_k = rest_f = np.empty(0, dtype=np.int64)
        passed = None  # the hot key whose rows are going by

        def reduce():
            nonlocal kept_a, kept_b, held
            if kept_a:
                a, b = stars(np.concatenate(kept_a), np.concatenate(kept_b))
                kept_a, kept_b, held = [a], [b], 0

        def take(k, f):
            nonlocal held
            for a, b in links_in_order(k, f, distance):
                kept_a.append(a)
                kept_b.append(b)
                held += len(a)
                if held >= FLUSH:
                    reduce()

        def whole(k, f):
            """Compares the keys of few rows; returns the rows of the others."""
            if hot is None or not len(k):
                take(k, f)
                return k[:0], f[:0]
            _, at, counts = np.unique(k, return_inverse=True, return_counts=True)
            many = counts[at] > hot
            take(k[~many], f[~many])
            return k[many], f[many]

        def rows(k, f):
            for at in range(0, len(k), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(f[part]), pa.nulls(len(k[part]), pa.int64())], names=["key", "a", "b"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False)
            if passed is not None:
                n = int(np.searchsorted(k, passed, side="right"))
                yield from rows(k[:n], f[:n])
                k, f = k[n:], f[n:]
                if len(k):
                    passed = None
            k, f = np.concatenate([rest_k, k]), np.concatenate([rest_f, f])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            yield from rows(*whole(k[:cut], f[:cut]))
            rest_k, rest_f = k[cut:], f[cut:]
            if hot is not None and len(rest_k) > hot:
                passed = int(rest_k[0])
                yield from rows(rest_k, rest_f)
                rest_k, rest_f = rest_k[:0], rest_f[:0]
        yield from rows(*whole(rest_k, rest_f))
        reduce()
        for a, b in zip(kept_a, kept_b, strict=True):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"])

    return run


def block_pairs(rows: DataFrame, hot: int) -> DataFrame:
    """(key, fp) rows of hot keys as (group, fp): once for each pair of blocks that holds the fingerprint's block."""
    rows = rows.repartition("fp")
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).select("key", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    dealt = rows.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("own")))
    paired = dealt.select("key", "fp", "own", F.explode(others).alias("other"))
    return paired.select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("group"), "fp")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Stars (a, b) that connect all fingerprints at ``distance`` or fewer bits; ``fps`` has distinct values ``fp``."""

    def spread(batches):
        for batch in batches:
            keys, owners = keys_of(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64))
            for at in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000]), pa.array(owners[at : at + 200_000])], names=["key", "fp"])

    def verified(rows, limit):
        dealt = rows.repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(_verify(distance, limit), "key long, a long, b long")

    first = materialise(verified(fps.select("fp").mapInArrow(spread, "key long, fp long"), hot))
    links, held = first.where("key IS NULL").select("a", "b"), first.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if held.isEmpty():
        return links
    # groups of equal hash are compared as one, which only adds pairs that are verified as well
    grouped = block_pairs(held, hot).select(F.xxhash64("group.key", "group.i", "group.j").alias("key"), "fp")
    return links.union(verified(grouped, None).select("a", "b"))


def near_duplicates(documents: DataFrame, words: int = WORDS, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id per row of ``documents``."""
    if distance > 4:
        raise ValueError("the keys guarantee links of up to four bits")
    docs = materialise(fingerprints(documents, words, seed))
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(fps, distance))
    rooted = fps.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
