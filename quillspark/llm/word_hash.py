"""Digests of all words of a byte string in a few numpy passes."""

from __future__ import annotations

from functools import cache

import numpy as np

from quillspark.llm.windows import mixed

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _hash_tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of an odd number modulo 2^64, and the powers' inverses."""
    rng = np.random.default_rng(20)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 1 << 63)) | 5
    steps = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    for x in steps:
        x[0] = 1
    return value, np.cumprod(steps[0]), np.cumprod(steps[1])


def word_digests(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, digest) of the words in bytes that end with a blank: words lie between blanks 0x20 and 0x09 to 0x0D."""
    value, power, inverse = _hash_tables(1 << max(16, len(data).bit_length()))
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[data] * power[: len(data)])))
    return start, end, mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
