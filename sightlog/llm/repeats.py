"""Exact substring de-duplication: every byte covered by a window of ``WIDTH`` bytes that also starts earlier is removed.

Equal windows are brought together first. The smallest hash of the byte grams in a window (its minimiser) depends on
the window alone, so equal windows have equal minimisers; a run of neighbouring windows with one minimiser is a short
string. Minimisers seen once hold no repeat and end there. Of the others, equal strings are one row with their earliest
place; copies within a task are told apart before anything is gathered, so a passage that a third of the rows share
is moved once for each task. The remaining distinct strings of a minimiser are compared window by window: blocks of strings are split into shards, each shard
gets its Burrows-Wheeler transform, and the transforms are merged by interleave refinement (``bwt``), whose classes after ``WIDTH``
rounds are the repeated intervals. All but the earliest window of a class are repeats.

The strings of a minimiser that more than ``HOT`` documents hold are not gathered: each is cut into its windows, and windows meet by a hash
of all their bytes, each once for each task with its earliest place. Equal windows have equal minimisers, so they are cut alike everywhere.

Order is by document id, then by start. Defined cases: null texts count as empty; texts shorter than a window lose nothing; null ids come
last; rows with equal ids are ordered by their place in the table; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlog.llm.bwt import repeated_windows
from sightlog.llm.common import map_batches, query, table
from sightlog.session import materialise

WIDTH, GRAM = 100, 24
#: Bytes of strings that are transformed and merged at once.
BLOCK = 250_000
#: Documents with a minimiser beyond which its strings are divided; windows that a task holds to find their copies.
HOT, HELD_WINDOWS = 20_000, 250_000
#: What a task holds at most to find its own copies, in minimisers and in bytes of strings.
HELD_RUNS, HELD_BYTES = 2_000_000, 64_000_000
#: Fixed odd multipliers of the gram hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST = (1 << 63) - 1


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed 64-bit hashes of all grams: polynomials of the bytes, built by doubling."""
    n = len(raw) - gram + 1
    base = np.uint64(MIX[0])
    with np.errstate(over="ignore"):
        level = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[1])
        total, done, size, power = None, 0, 1, base
        while True:
            if gram & size:
                total = level.copy() if total is None else _append(total, level, done, power)
                done += size
            if size * 2 > gram:
                break
            level = level[:-size] * power + level[size:]
            power = power * power
            size *= 2
        h = total[:n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX[1])
        h ^= h >> np.uint64(32)
    return h


def _append(total, level, done, power):
    n = min(len(total), len(level) - done)
    return total[:n] * power + level[done : done + n]


def sliding(values: np.ndarray, span: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each window of ``span`` values."""
    out, reach = values, 1
    while reach * 2 <= span:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    rest = span - reach
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def window_runs(raw: bytes, width: int = WIDTH, gram: int = GRAM):
    """Runs of windows with one minimiser: (minimiser, first window, end of the last window, whether its bytes hold the gram more
    than once). Only a run that does can hold two equal windows."""
    if len(raw) < width:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    span = width - gram + 1
    hashes = gram_hashes(np.frombuffer(raw, dtype=np.uint8), gram)
    low = sliding(hashes, span, np.minimum)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    end = np.concatenate([first[1:], [len(low)]]) + width - 1
    value = low[first]
    # places that are the minimum of a window; a run's own are those between its ends with its value
    around = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    places = np.flatnonzero(hashes == sliding(around, span, np.maximum))
    at, stop = np.searchsorted(places, first), np.searchsorted(places, end - gram, side="right")
    found, step = np.zeros(len(first), np.int64), 0
    while (more := at + step < stop).any():
        found[more] += hashes[places[at[more] + step]] == value[more]
        step += 1
    return value.view(np.int64), first, end, found > 1


def merge_intervals(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _runs(width: int, gram: int):
    """Minimisers of a task's rows as (pass, key, other): one row (low, uid) for each minimiser that the task has once, one row (low, -1) for
    each that it has more often, and for the latter all rows (uid, low), marked as known repeats."""

    def emit(low, uid):
        values, at, counts = np.unique(low, return_inverse=True, return_counts=True)
        often = counts[at] > 1
        known = np.unique(np.stack([uid[often], low[often]], axis=1), axis=0)
        heads = values[counts > 1]
        mark = np.concatenate([np.zeros(len(low) - often.sum() + len(heads), bool), np.ones(len(known), bool)])
        key = np.concatenate([low[~often], heads, known[:, 0]])
        other = np.concatenate([uid[~often], np.full(len(heads), -1), known[:, 1]])
        for i in range(0, len(key), 200_000):
            part = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(mark[part]), pa.array(key[part]), pa.array(other[part])], names=["pass", "key", "other"])

    def run(batches):
        lows, uids, held = [], [], 0
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, _, _, twice = window_runs((text or "").encode(), width, gram)
                low = np.concatenate([low, low[twice]])
                lows.append(low)
                uids.append(np.full(len(low), uid, dtype=np.int64))
                held += len(low)
            if held >= HELD_RUNS:
                yield from emit(np.concatenate(lows), np.concatenate(uids))
                lows, uids, held = [], [], 0
        if held:
            yield from emit(np.concatenate(lows), np.concatenate(uids))

    return run


def _shared(batches):
    """(uid, low) of the known repeats and of minimisers that several tasks have; rows come sorted by (pass, key)."""

    def emit(mark, key, other):
        same = key[1:] == key[:-1]
        several = np.zeros(len(key), bool)
        several[1:] |= same
        several[:-1] |= same
        take = several & ~mark & (other >= 0)
        uid, low = np.concatenate([key[mark], other[take]]), np.concatenate([other[mark], key[take]])
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(low)], names=["uid", "low"])

    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if rest is not None:
            columns = [np.concatenate([r, c]) for r, c in zip(rest, columns, strict=True)]
        mark, key, _ = columns
        whole = len(key) if mark[-1] else int(np.searchsorted(key[~mark], key[-1]))  # the last key may go on
        if whole:
            yield emit(*(c[:whole] for c in columns))
        rest = [c[whole:] for c in columns]
    if rest is not None and len(rest[0]):
        yield emit(*rest)


def _strings(width: int, gram: int, names: list[str]):
    """Strings of the shared minimisers, of those in ``hots`` windows: each distinct one of a task once, with its earliest place; the places
    of its copies as spans."""
    columns = [names.index(n) for n in ("uid", "doc_id", "text", "lows", "hots")]

    def emit(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(STRING_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, STRING_TYPES.values(), strict=True)], names=list(STRING_TYPES))

    def key(window):
        return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)

    def whole(first, divided):
        """Rows of the strings, with windows in place of those of divided minimisers."""
        windows: dict[bytes, tuple] = {}
        out = []

        def close():
            out.extend((False, key(w), *place, width, w, False) for w, place in windows.items())
            windows.clear()

        for s, (r, u, a, l, w) in first.items():
            if l not in divided:
                out.append((False, l, r, u, a, len(s), s, w))
            for at in range(len(s) - width + 1) if l in divided else ():
                part, new = s[at : at + width], (r, u, a + at)
                old = windows.setdefault(part, new)
                if old != new:
                    windows[part] = min(old, new)
                    _, u2, p = max(old, new)
                    out.append((True, u2, None, u2, p, width, None, None))
            if len(windows) >= HELD_WINDOWS:
                close()
            if len(out) >= 20_000:
                yield emit(out)
                out = []
        close()
        for i in range(0, len(out), 20_000):
            yield emit(out[i : i + 20_000])

    def run(batches):
        first: dict[bytes, tuple] = {}  # by the string
        divided: set[int] = set()
        held = 0
        for batch in batches:
            copies = []
            for uid, doc_id, text, lows, hots in zip(*(batch.column(i).to_pylist() for i in columns), strict=True):
                raw = (text or "").encode()
                divided.update(hots)
                rank = LAST if doc_id is None else doc_id
                low, start, end, twice = window_runs(raw, width, gram)
                take = np.isin(low, np.array(lows, dtype=np.int64))
                for l, a, b, w in zip(*(x[take].tolist() for x in (low, start, end, twice)), strict=True):
                    s = raw[a:b]
                    old, new = first.get(s), (rank, uid, a, l, w)
                    if old is None:
                        first[s] = new
                        held += b - a
                        continue
                    if new[:3] < old[:3]:
                        first[s], new = new, old
                    copies.append((True, new[1], None, new[1], new[2], b - a, None, None))
                if held >= HELD_BYTES:
                    yield from whole(first, divided)
                    first, held = {}, 0
            yield emit(copies)
        yield from whole(first, divided)

    return run


STRING_TYPES = {"pass": pa.bool_(), "key": pa.int64(), "rank": pa.int64(), "uid": pa.int64(), "start": pa.int64(), "size": pa.int64(), "string": pa.binary(), "twice": pa.bool_()}
STRING_ROW = "pass boolean, key long, rank long, uid long, start long, size long, string binary, twice boolean"


def _compare(width: int):
    """Repeated spans (uid, a, b). Rows come sorted by (pass, minimiser, string, place): the first row of a string is the earliest, its other
    rows are copies; the distinct strings of a minimiser are compared window by window."""

    def spans(uid, a, b):
        return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (uid, a, b)], names=["uid", "a", "b"])

    def repeats(rows):
        number, offset, classes = repeated_windows([r[6] for r in rows], width)
        uid = np.array([r[3] for r in rows], dtype=np.int64)[number]
        place = np.array([r[4] for r in rows], dtype=np.int64)[number] + offset
        order = np.lexsort((place, uid, np.array([r[2] for r in rows], dtype=np.int64)[number], classes))
        later = order[1:][classes[order][1:] == classes[order][:-1]]  # the earliest of each class stays
        later = later[np.lexsort((place[later], uid[later]))]
        u, p = uid[later], place[later]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (p[1:] > p[:-1] + 1)
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(u) - 1]]) if len(u) else np.empty(0, int)
        return spans(u[new], p[new], p[last] + width)

    def run(batches):
        group, block, held = [], [], 0

        def close():
            nonlocal group, held
            if len(group) > 1 or group and group[0][7]:  # a lone string repeats at most itself
                block.extend(group)
                held += sum(r[5] for r in group)
            group = []

        for batch in batches:
            copies = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0]:
                    copies.append(row)
                    continue
                if group and row[1] != group[0][1]:
                    close()
                    if held >= BLOCK:
                        yield repeats(block)
                        block, held = [], 0
                if group and row[6] == group[-1][6]:
                    copies.append(row)
                else:
                    group.append(row)
            yield spans([r[3] for r in copies], [r[4] for r in copies], [r[4] + r[5] for r in copies])
        close()
        if block:
            yield repeats(block)

    return run


def repeated_spans(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(uid, spans) of the removed runs of bytes, from rows with ``uid``, ``doc_id`` and ``text``.

    Tasks name what they have already seen twice, so that a passage comes from each task once, however many of its rows share it.
    """
    runs = rows.select("uid", "text").mapInArrow(_runs(width, gram), "pass boolean, key long, other long")
    shared = materialise(runs.repartition("key").sortWithinPartitions("pass", "key").mapInArrow(_shared, "uid long, low long"))
    divided = shared.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("low").alias("hot"))
    marked = shared.join(F.broadcast(divided), F.col("low") == F.col("hot"), "left")
    held = rows.join(marked.groupBy("uid").agg(F.collect_set("low").alias("lows"), F.collect_set("hot").alias("hots")), "uid")
    # all columns go in, so that this shuffle of the rows serves the last join too
    strings = held.mapInArrow(_strings(width, gram, held.columns), STRING_ROW)
    dealt = strings.repartition("key").sortWithinPartitions("pass", "key", "string", "rank", "uid", "start")
    found = dealt.mapInArrow(_compare(width), "uid long, a long, b long")
    return found.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remaining(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left outside of the spans, and the number of maximal removed runs."""
    merged = merge_intervals(spans)
    keep, at = [], 0
    for a, b in merged:
        keep.append(raw[at:a])
        at = b
    return b"".join([*keep, raw[at:]]), len(merged)


def with_spans(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The rows of ``documents`` (a stored table, whose rows keep their places) with the spans of bytes to remove, null for none."""
    rows = documents.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("uid", F.monotonically_increasing_id())
    return rows.join(repeated_spans(rows, width, gram), "uid", "left")


def deduplicate(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The columns of ``documents`` with the repeats cut out of ``text``; a character of which only a part is left goes too."""

    def cut(texts, spans):
        return [[t if s is None else remaining((t or "").encode(), [(x["a"], x["b"]) for x in s])[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]]

    names = documents.columns
    found = with_spans(documents, width, gram)
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = cut(columns["text"].to_pylist(), columns["spans"].to_pylist())[0]
            yield pa.RecordBatch.from_arrays([pa.array(texts, type=pa.string()) if n == "text" else columns[n] for n in names], names=names)

    return found.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def deduplicate_digests(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row."""

    def digests(ids, texts, spans):
        rows = []
        for text, found in zip(texts, spans, strict=True):
            raw = (text or "").encode()
            kept, runs = remaining(raw, [(x["a"], x["b"]) for x in found or ()])
            rows.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        return [ids, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 4)]

    found = with_spans(documents.select("doc_id", "text"), width, gram)
    return map_batches(found.select("doc_id", "text", "spans"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digests)


@query("op8_repeats")
def op8_repeats(spark, sf_dir):
    return deduplicate_digests(table(spark, sf_dir, "documents"))
