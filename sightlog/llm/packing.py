"""Best-fit packing of documents into sequences: large items are matched, small ones fill the gaps.

Documents are tokenised and cut in one pass. What a packing depends on is the number of pieces of each length, at most
``CAPACITY`` numbers. From this histogram a plan is made: pieces over a third of the capacity share a sequence with at
most one other of them, so the largest is matched with the largest that fits, downwards; smaller pieces, longest first, go into the
smallest gap that holds them, and new sequences open only when none does. Equal steps are taken for all equal pieces at once,
so the plan's size follows the number of lengths, not of documents. Then each piece finds its place by its
rank among the pieces of its length: a running number in its partition plus the counts of the partitions before.

Defined cases: a null text is empty and packs as the single end id; repeated rows are packed each; null ids stay null; further
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightlog.llm.common import query, table
from sightlog.session import materialise

CAPACITY, END_ID = 2048, 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(path: str = TOKENIZER):
    """The ids of the tokenizer file, by the faster of two libraries where both give the same.

    A byte-level file with the public pattern is a plain table of ranks; any other file, and any text with an added token of the
    file, is encoded by ``tokenizers`` with its defaults.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec["pre_tokenizer"] or {}
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(path)
    whole = lambda text: np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not spec["normalizer"]
    if not plain or spec["model"]["type"] != "BPE" or spec["model"].get("ignore_merges"):
        return whole
    import tiktoken

    # the printable stand-ins of bytes in such files: printable Latin-1 stands for itself, the others follow from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    # a text that holds an added token is cut there first, as the library does
    special = {t["content"] for t in spec["added_tokens"]}
    held = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")
    ranks = {bytes(back[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: whole(text) if held.search(text) else np.asarray(enc.encode_ordinary(text), dtype=np.uint32)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, the first takes what is over."""
    n = len(ids)
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its partition and its number among the pieces of equal length of that partition."""

    def run(batches):
        encode = encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(cut(ids, capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows.append((doc_id, piece, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Plan:
    """Places for ``counts[length]`` pieces of each length: runs of (first rank, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, count)
        self.open: list[int] = []  # gaps in use, ascending
        self.rank = dict.fromkeys(counts, 0)
        self.runs: dict[int, list[tuple[int, int, int]]] = {length: [] for length in counts}
        large = {length: n for length, n in counts.items() if 3 * length > capacity and n}
        self._match(large)
        for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
            self._best_fit(length, counts[length])

    def _assign(self, length: int, first: int, count: int, offset: int) -> None:
        self.runs[length].append((self.rank[length], first, offset))
        self.rank[length] += count

    def _leave(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.gaps:
                self.gaps[gap] = []
                self.open.insert(bisect_left(self.open, gap), gap)
            self.gaps[gap].append((first, count))

    def _new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _match(self, left: dict[int, int]) -> None:
        order = sorted(left)
        while order:
            length = order[-1]
            at = bisect_left(order, self.capacity - length + 1) - 1  # the largest that fits beside it
            if at < 0:
                count, other = left[length], None
            elif order[at] == length:
                count, other = left[length] // 2, length
                if not count:
                    count, other = 1, order[at - 1] if at else None
            else:
                other = order[at]
                count = min(left[length], left[other])
            first = self._new(count)
            self._assign(length, first, count, 0)
            left[length] -= count
            if other is not None:
                self._assign(other, first, count, length)
                left[other] -= count
            self._leave(self.capacity - length - (other or 0), first, count)
            for x in {length, other} - {None}:
                if not left[x]:
                    order.remove(x)

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            at = bisect_left(self.open, length)
            if at == len(self.open):
                # no gap holds it: whole sequences of this length, and one with what is over
                per = self.capacity // length
                for count, depth in ((n // per, per), (int(n % per > 0), n % per)):
                    first = self._new(count)
                    for i in range(depth if count else 0):
                        self._assign(length, first, count, i * length)
                    self._leave(self.capacity - depth * length, first, count)
                return
            gap = self.open[at]
            first, count = self.gaps[gap].pop()
            used = min(count, n)
            if used < count:
                self.gaps[gap].append((first + used, count - used))
            elif not self.gaps[gap]:
                del self.gaps[gap], self.open[at]
            self._assign(length, first, used, self.capacity - gap)
            self._leave(gap - length, first, used)
            n -= used

    def arrays(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*runs, strict=True)) for length, runs in self.runs.items() if runs}


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    pieces = materialise(pieces_of(documents, tokenizer, capacity))
    counts = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = Plan(totals, capacity).arrays()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                first_rank, first_sequence, place_of = plan[int(lengths[at[0]])]
                run = np.searchsorted(first_rank, ranks[at], side="right") - 1
                sequence[at], offset[at] = first_sequence[run] + ranks[at] - first_rank[run], place_of[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
