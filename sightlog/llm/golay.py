"""The binary Golay code (23, 12): decoding of 23-bit values to nearby codewords, on numpy arrays.

Every value lies within three bits of exactly one codeword. A value at three bits from it lies at four bits from exactly
five more. Two values that differ in at most two bits have a midpoint within one bit of both, whose codeword is within
four bits of both: so the codewords within four bits are keys that such values always share.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

GENERATOR = 0xAE3  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BITS, CHECK = 23, 11


def _remainder(value: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - CHECK)
    return value


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 11 and the high 12 bits; per syndrome the error patterns of at most four bits (-1: none)."""
    unit = [_remainder(1 << b) for b in range(BITS)]

    def syndromes(first: int, count: int) -> np.ndarray:
        out = np.zeros(1 << count, dtype=np.int64)
        for b in range(count):
            out[1 << b : 2 << b] = out[: 1 << b] ^ unit[first + b]
        return out

    errors = np.full((1 << CHECK, 6), -1, dtype=np.int64)
    filled = np.zeros(1 << CHECK, dtype=np.int64)
    for weight in range(5):
        for bits in itertools.combinations(range(BITS), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= unit[b]
            errors[syndrome, filled[syndrome]] = sum(1 << b for b in bits)
            filled[syndrome] += 1
    return syndromes(0, CHECK), syndromes(CHECK, BITS - CHECK), errors


def indices(values: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) within four bits of each value: shape (n, 6), -1 where there are fewer."""
    low, high, errors = tables()
    found = errors[low[values & ((1 << CHECK) - 1)] ^ high[values >> CHECK]]
    return np.where(found < 0, -1, (values[:, None] ^ found) >> CHECK)
