"""Near-duplicates at a word-shingle similarity, from the fuzzy keys of ``simhash``.

``simhash`` guarantees links of four bits, which is a Jaccard similarity of 0.96 and more. Its keys reach further: pairs of Golay indices are shared by most
fingerprints that differ in up to REACH bits, the distance of texts with a Jaccard similarity of 0.8 (measured on sf0.1: by 97 of 100 such pairs,
and by all of them if a second word of 64 bits, from other bits of the same shingle hashes, gives keys as well). So candidates are rows of a
key that differ in at most REACH bits of either word, which keeps rows apart that only share a key; they leave a task as stars, never as pairs. Components of candidates are
then settled exactly: each member is compared with the kept documents of its component, by the Jaccard similarity of all its five-word
shingles, and goes only if that is SIMILARITY or more to one of them. Members come in the order of their places, so every member has been compared
with all kept ones before it. Equal texts are one row before all this.

A component is settled in rounds of blocks, and no text moves once per pair. The first LEADERS members (fewer, if their texts come to ROOM characters) meet in one
task, in order; those of them that stay then meet the rest of the component, which is dealt to groups of GROUP members, and what is like none
of them goes on to the next round. So a component of n members takes n / LEADERS rounds, its texts move once a round, and no task holds
more than a block of it; components of up to LEADERS members, nearly all, are settled at once. A key with more than ``simhash.HOT``
rows is dealt to blocks, whose pairs are groups of their own, as in ``simhash``.

Defined cases: null texts count as empty; texts of fewer than five words are one shingle, texts without words are alike; repeated rows
are told apart by their place, equal texts are duplicates; ids are places of rows, so they may repeat or be null.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightlog.llm import simhash
from sightlog.llm.common import components, map_batches
from sightlog.session import materialise

REACH, SHINGLE, SIMILARITY = 14, 5, 0.8
#: Members of a component that lead a round, characters of them, and members that meet them in one task.
LEADERS, ROOM, GROUP = 512, 1 << 22, 2048


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    found = {b" ".join(tokens[i : i + words]) for i in range(max(len(tokens) - words + 1, 1))}
    return np.unique(np.fromiter((xxh64_intdigest(x) for x in found), dtype=np.uint64, count=len(found)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def candidate_links(fps: DataFrame, reach: int = REACH, hot: int = simhash.HOT) -> DataFrame:
    """Stars (a, b) over fingerprints that share a key and are close in both words; ``fps`` has distinct ``fp`` with ``more``."""

    def spread(batches):
        for batch in batches:
            fp, more = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=np.int64) for i in range(2))
            for no, word in enumerate((fp, more)):
                keys, places = simhash.key_rows(word.view(np.uint64))
                keys = (keys + (no << 26)).astype(np.int32)
                for at in range(0, len(keys), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(fp[places[part]]), pa.array(more[places[part]])], names=["key", "fp", "more"])

    def verified(limit):
        def run(batches):
            kept: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            rest = [np.empty(0, dtype=np.int64)] * 3
            passed = None

            def compare(k, f, m):
                nonlocal held
                for a, b in simhash.links_in_order(k, f, reach, m):
                    kept.append((a, b))
                    held += len(a)
                    if held >= simhash.FLUSH:
                        joined = simhash.stars(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
                        kept[:] = [joined]
                        held = 0

            def rows(k, f, m):
                for at in range(0, len(k), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(k[part].astype(np.int64)), pa.array(f[part]), pa.array(m[part])], names=["key", "a", "b"])

            def settle(k, f, m):
                """Compares keys of few rows; the rows of the others are handed on."""
                if not len(k):
                    return
                _, at, counts = np.unique(k, return_inverse=True, return_counts=True)
                many = counts[at] > limit if limit else np.zeros(len(k), dtype=bool)
                compare(k[~many], f[~many], m[~many])
                yield from rows(k[many], f[many], m[many])

            for batch in batches:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                if passed is not None:
                    n = int(np.searchsorted(now[0], passed, side="right"))
                    yield from rows(*(c[:n] for c in now))
                    now = [c[n:] for c in now]
                    passed = passed if not len(now[0]) else None
                now = [np.concatenate(pair) for pair in zip(rest, now, strict=True)]
                if not len(now[0]):
                    continue
                cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
                yield from settle(*(c[:cut] for c in now))
                rest = [c[cut:] for c in now]
                if limit and len(rest[0]) > limit:
                    passed = int(rest[0][0])
                    yield from rows(*rest)
                    rest = [c[:0] for c in rest]
            yield from settle(*rest)
            if kept:
                a, b = simhash.stars(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"])

        return run

    def dealt(rows, limit):
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verified(limit), "key long, a long, b long")

    first = materialise(dealt(fps.select("fp", "more").mapInArrow(spread, "key int, fp long, more long"), hot))
    links = first.where("key IS NULL").select("a", "b")
    held = first.where("key IS NOT NULL").select("key", F.col("a").alias("fp"), F.col("b").alias("more"))
    if held.isEmpty():
        return links
    grouped = simhash.block_pairs(held.select("key", "fp"), hot).select(F.xxhash64("group.key", "group.i", "group.j").alias("key"), "fp")
    second = held.select("fp", "more").distinct()
    return links.union(dealt(grouped.join(second, "fp").select("key", "fp", "more"), None).select("a", "b"))


def duplicates(documents: DataFrame, similarity: float = SIMILARITY, leaders: int = LEADERS, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """(row, kept): rows that are like a kept row of smaller ``place``. ``documents`` is (row, place, text); ``row`` is unique, ``place`` orders."""

    def run(rows, places, texts):
        both = [simhash._majority(t or "", simhash.WORDS, simhash.SEED, 2) for t in texts]
        return [rows, places, [b[0] for b in both], [b[1] for b in both], [len(t or "") for t in texts], [sha256((t or "").encode()).hexdigest() for t in texts]]

    docs = materialise(map_batches(documents.select("row", "place", "text"), "row long, place long, fp long, more long, size long, sha string", run))
    # equal texts need no comparison and move no text: the first of each stands for all
    first = docs.groupBy("sha").agg(F.min(F.struct("place", "row", "fp", "more", "size")).alias("m"))
    equal = docs.select("row", "sha").join(first.select("sha", F.col("m.row").alias("kept")), "sha").where("row <> kept").select("row", "kept")
    single = materialise(first.select("m.*"))
    fps = single.groupBy("fp").agg(F.min("more").alias("more"))
    roots = components(candidate_links(fps))
    placed = single.select("row", "place", "size", "fp").join(roots.withColumnRenamed("id", "fp"), "fp", "left")
    grouped = placed.select("row", "place", "size", F.coalesce("root", "fp").alias("root"))
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    # only texts of components are compared, and only they are stored
    open_rows = materialise(grouped.join(sizes, "root").join(documents.select("row", "text"), "row").select("root", "row", "place", "size", "text"))
    found = equal
    while open_rows is not None:
        alike, open_rows = _settled(open_rows, similarity, leaders, room, group)
        for part in alike:
            found = found.union(part)
    return found


def _settled(open_rows: DataFrame, similarity: float, leaders: int, room: int, group: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(row, kept) of rows like a kept one of the first block of their component, and the rows that are like none (none left: None)."""
    ids = open_rows.select("root", "place", "row", "size")
    order = Window.partitionBy("root").orderBy("place", "row")
    block = ids.withColumn("no", F.row_number().over(order)).where(F.col("no") <= leaders)
    block = block.withColumn("before", F.sum("size").over(order) - F.col("size")).where(F.col("before") < room)
    ends = block.groupBy("root").agg(F.max(F.struct("place", "row")).alias("end"), F.count("*").alias("led"))
    left = ids.groupBy("root").agg(F.count("*").alias("n")).join(ends, "root").where("n > led")
    # one row for each component that goes on after its block, so it is far smaller than what it is joined with
    cuts = materialise(left.select("root", "end", F.ceil((F.col("n") - F.col("led")) / group).cast("int").alias("groups")))
    # grouped again, so that Spark knows one row a root: it would take the product of both sizes, and numbers that double their digits each round fill the driver
    single = cuts.groupBy("root").agg(F.max("end").alias("end"), F.max("groups").alias("groups"))
    marked = open_rows.join(F.broadcast(single), "root", "left").withColumn("later", F.coalesce(F.struct("place", "row") > F.col("end"), F.lit(False)))
    rows = marked.where(~F.col("later")).select("root", "place", "row", "groups", "text")
    ahead = rows.repartition("root").sortWithinPartitions("root", "place", "row").mapInArrow(_in_order(similarity), "root long, place long, row long, groups int, kept long, text string")
    ahead = materialise(ahead)
    gone = [_pairs(ahead)]
    if cuts.isEmpty():
        return gone, None
    heads = ahead.where("kept IS NULL AND groups IS NOT NULL").select(
        "root", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(False).alias("later"), "place", "row", F.lit(None).cast("long").alias("size"), "text"
    )
    rest = marked.where("later").select("root", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int").alias("group"), "later", "place", "row", "size", "text")
    met = heads.union(rest).repartition("root", "group").sortWithinPartitions("root", "group", "later", "place", "row")
    met = materialise(met.mapInArrow(_against(similarity), "root long, place long, row long, size long, kept long, text string"))
    gone.append(_pairs(met))
    open_rows = met.where("kept IS NULL").select("root", "row", "place", "size", "text")
    return gone, None if open_rows.isEmpty() else open_rows


def _pairs(settled: DataFrame) -> DataFrame:
    """The pairs alone are stored, so that texts of a round go with it."""
    return materialise(settled.where("kept IS NOT NULL").select("row", "kept"))


class _Kept:
    """Shingle sets of kept rows, in order, side by side as numbers of a common list."""

    def __init__(self):
        self.numbers: dict[int, int] = {}
        self.rows: list[int] = []
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.flat, self.used = np.empty(1024, dtype=np.int64), 0
        self.seen = np.zeros(1024, dtype=bool)

    def add(self, row: int, own: np.ndarray) -> None:
        end = self.used + len(own)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * end - self.used, dtype=np.int64)])
        self.flat[self.used : end] = [self.numbers.setdefault(h, len(self.numbers)) for h in own.tolist()]
        if len(self.numbers) > len(self.seen):
            self.seen = np.zeros(2 * len(self.numbers), dtype=bool)
        self.rows.append(row)
        self.starts.append(self.used)
        self.sizes.append(len(own))
        self.used = end

    def first_like(self, own: np.ndarray, similarity: float) -> int | None:
        """The first kept row with a Jaccard similarity of ``similarity`` or more."""
        known = [i for i in map(self.numbers.get, own.tolist()) if i is not None]
        if not known:
            return None
        self.seen[known] = True
        both = np.add.reduceat(self.seen[self.flat[: self.used]], self.starts, dtype=np.int64)
        self.seen[known] = False
        like = np.nonzero(both / (len(own) + np.array(self.sizes) - both) >= similarity)[0]
        return self.rows[like[0]] if len(like) else None


def _in_order(similarity: float):
    """Rows of a component in order: each is kept, or goes with the first kept one that it is like. Texts go on only where they lead a longer component."""

    def run(batches):
        now, kept = None, _Kept()
        for batch in batches:
            roots, _, rows, groups, texts = (c.to_pylist() for c in batch.columns)
            found, on = [], []
            for root, row, more, text in zip(roots, rows, groups, texts, strict=True):
                if root != now:
                    now, kept = root, _Kept()
                own = shingles(text)
                found.append(kept.first_like(own, similarity))
                if found[-1] is None:
                    kept.add(row, own)
                on.append(text if found[-1] is None and more is not None else None)
            columns = [*batch.columns[:4], pa.array(found, pa.int64()), pa.array(on, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "place", "row", "groups", "kept", "text"])

    return run


def _against(similarity: float):
    """The later rows of each group, with the first of the group's leading rows that they are like; texts of the others go on."""

    def run(batches):
        now, kept = None, _Kept()
        for batch in batches:
            roots, numbers, later, places, rows, sizes, texts = (c.to_pylist() for c in batch.columns)
            out = []
            for root, number, after, place, row, size, text in zip(roots, numbers, later, places, rows, sizes, texts, strict=True):
                if (root, number) != now:
                    now, kept = (root, number), _Kept()
                own = shingles(text)
                if not after:
                    kept.add(row, own)
                    continue
                first = kept.first_like(own, similarity)
                out.append((root, place, row, size, first, text if first is None else None))
            types = [pa.int64()] * 5 + [pa.string()]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "place", "row", "size", "kept", "text"])

    return run
