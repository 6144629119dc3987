"""Burrows-Wheeler transforms of sets of byte strings, and their merge by interleave refinement, on numpy arrays.

A shard is the circular concatenation of its strings, each closed by ``END`` (a byte that UTF-8 never holds). ``suffix_order`` sorts
its suffixes by doubling. ``merge`` never sorts suffixes again: it holds the interleave, the shard of each suffix in merged
order, starts with the shards one after another and refines it: dealing the positions stably by the byte before each
suffix (which the transforms hold) turns an order by h bytes into one by h + 1 bytes. The same pass carries the classes of equal
prefixes, so after ``depth`` rounds the suffixes with a common prefix of ``depth`` bytes are those of one class.
"""

from __future__ import annotations

import numpy as np

END = 0xFF


def concatenate(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(bytes([END]).join(strings) + bytes([END]), dtype=np.uint8) if strings else np.empty(0, np.uint8)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of the circular text in order; the transform is the byte before each."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    wrapped = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | wrapped[i : i + n]
    order = np.argsort(key, kind="stable")
    depth = 8
    while True:
        sorted_key = key[order]
        change = np.empty(n, dtype=bool)
        change[0], change[1:] = False, sorted_key[1:] != sorted_key[:-1]
        classes = np.cumsum(change)
        if classes[-1] == n - 1 or depth >= n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = classes
        key = rank * n + np.roll(rank, -(depth % n))
        # only suffixes in a class with others still move
        tied = np.zeros(n, dtype=bool)
        tied[1:] |= ~change[1:]
        tied[:-1] |= ~change[1:]
        moving = np.flatnonzero(tied)
        order[moving] = order[moving][np.argsort(key[order[moving]], kind="stable")]
        depth *= 2


def symbols(text: list[np.ndarray], orders: list[np.ndarray], depth: int) -> tuple[int, list[np.ndarray]]:
    """The bytes before each suffix, as many at a time as 16-bit numbers in their order can name: (bytes at a time, one array per shard).

    With two or four bytes the transform is that of the same text over a larger alphabet, and a round refines by as many bytes.
    """
    for step in (4, 2):
        if depth % step == 0:
            parts = []
            for order, t in zip(orders, text, strict=True):
                word = np.zeros(len(t), dtype=np.uint32)
                for back in range(step, 0, -1):
                    word = word << np.uint32(8) | t[order - back]
                parts.append(word)
            seen = np.unique(np.concatenate(parts))
            if len(seen) <= 1 << 16:
                return step, [np.searchsorted(seen, w).astype(np.uint16) for w in parts]
    return 1, [t[order - 1] for order, t in zip(orders, text, strict=True)]


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (shard of each suffix) in the order by ``rounds`` symbols, and the class of that prefix."""
    sizes = [len(t) for t in transforms]
    n = sum(sizes)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)
    classes = np.zeros(n, dtype=np.int32)
    before = np.empty(n, dtype=transforms[0].dtype)
    change = np.empty(n, dtype=bool)
    for _ in range(rounds):
        for j, t in enumerate(transforms):
            before[shard == j] = t
        order = np.argsort(before, kind="stable")  # a radix sort of small numbers
        shard = shard[order]
        symbol, old = before[order], classes[order]
        change[:1] = False
        np.not_equal(symbol[1:], symbol[:-1], out=change[1:])
        change[1:] |= old[1:] != old[:-1]
        classes = np.cumsum(change, dtype=np.int32)
    return shard, classes


def repeated_windows(strings: list[bytes], width: int, shards: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows of ``width`` bytes that occur more than once, as arrays (string number, start, class number).

    Strings are dealt to shards in turn; shards are transformed on their own and merged.
    """
    parts, owners, orders = [], [], []
    for j in range(min(shards, len(strings))):
        own = strings[j::shards]
        lengths = np.array([len(s) + 1 for s in own])
        text = concatenate(own)
        starts = np.cumsum(lengths) - lengths
        number = np.repeat(np.arange(len(own)), lengths)
        offset = np.arange(len(text)) - starts[number]
        whole = offset + width < lengths[number]  # the window ends before the end mark
        parts.append(text)
        owners.append((number * shards + j, offset, whole))
        orders.append(suffix_order(text))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    step, transforms = symbols(parts, orders, width)
    shard, classes = merge(transforms, width // step)
    number, offset, whole = (np.empty(len(shard), dtype=k) for k in (np.int64, np.int64, bool))
    for j, order in enumerate(orders):
        at = shard == j
        for out, values in zip((number, offset, whole), owners[j], strict=True):
            out[at] = values[order]
    keep = np.flatnonzero(whole)
    number, offset, classes = number[keep], offset[keep], classes[keep]
    counts = np.bincount(classes) if len(classes) else np.zeros(0, int)
    many = counts[classes] > 1 if len(classes) else np.zeros(0, bool)
    return number[many], offset[many], classes[many]
