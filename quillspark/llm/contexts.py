"""Exact comparison of the windows of many contexts by depth-limited radix sorts.

All contexts hold the seed of their windows. What stands from the seed on, and what stands before it, read backwards, are
sorted each by most-significant-digit passes, no deeper than a window reaches; a group that has shrunk to one is dropped
at once. A window with ``a`` symbols before the seed equals another exactly if both share those ``a`` symbols and the
``length - a`` from the seed on: it is known by its group in either order at those depths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Contexts that are compared at a time; those of one seed are never parted.
CHUNK = 20_000


def radix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``symbols`` in order, how many leading symbols each shares with the one before it; -1 at first)."""
    n, depth = symbols.shape
    order, common = np.arange(n), np.full(n, depth)
    common[:1] = -1
    active, group = np.arange(n), np.zeros(n, np.int64)  # places in ``order`` that share all symbols so far with a neighbour
    for d in range(depth):
        if len(active) < 2:
            break
        rows = order[active]
        by = np.lexsort((symbols[rows, d], group))
        rows = rows[by]
        order[active] = rows
        digit = symbols[rows, d]
        same = group[1:] == group[:-1]
        parts = same & (digit[1:] != digit[:-1])
        common[active[1:][parts]] = d
        begins = np.concatenate(([True], ~same | parts))
        group = np.cumsum(begins)
        alone = begins & np.concatenate((begins[1:], [True]))
        active, group = active[~alone], group[~alone]
    return order, common


def byte_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for rows of bytes (a multiple of eight), in digits of eight bytes; what they share is counted in bytes."""
    digits = rows.view(">u8").astype(np.uint64)
    order, common = radix_order(digits)
    at = np.flatnonzero((common >= 0) & (common < digits.shape[1]))
    differs = digits[order[at], common[at]] ^ digits[order[at - 1], common[at]]
    common[1:] *= 8
    for b in range(1, 8):
        common[at] += differs >> np.uint64(64 - 8 * b) == 0
    return order, common


def classes(left: tuple, right: tuple, offset: np.ndarray, count: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(contexts, their windows, class of each) for all symbols before the seed: windows are equal exactly if their classes are.

    ``left`` and ``right``: (order, common) of what stands before the seeds, backwards, and from them on. Context i has
    ``count[i]`` windows; the first begins ``offset[i]`` symbols before the seed, the next one symbol later.
    """
    n = len(offset)
    places = np.arange(n)
    sides = []
    for order, common in (left, right):
        rank = np.empty(n, np.int64)
        rank[order] = places
        sides.append((rank, common))
    (left_rank, left_common), (right_rank, right_common) = sides
    for a in range(int(offset.max(initial=-1)) + 1):
        who = np.flatnonzero((offset >= a) & (offset - count < a))
        if len(who):
            one = np.maximum.accumulate(np.where(left_common < a, places, 0))[left_rank[who]]
            two = np.maximum.accumulate(np.where(right_common < length - a, places, 0))[right_rank[who]]
            yield who, offset[who] - a, one * n + two


def chunks(seeds: np.ndarray) -> Iterator[slice]:
    """Slices of sorted ``seeds`` of about ``CHUNK`` places that don't part equal ones."""
    low = 0
    while low < len(seeds):
        high = len(seeds) if low + CHUNK >= len(seeds) else int(np.searchsorted(seeds, seeds[low + CHUNK - 1], "right"))
        yield slice(low, high)
        low = high
