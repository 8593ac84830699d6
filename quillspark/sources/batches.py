"""Arrow batches in pieces, so that a Python worker holds the objects of a piece only, whatever the size of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of Arrow data that are turned into Python objects at a time; a larger row stands alone.
PIECE_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch | pa.Array, most: int = PIECE_BYTES) -> Iterator:
    """``batch``, in order, halved until a part has at most ``most`` bytes or one row; nothing is copied."""
    n = len(batch)
    if n < 2 or batch.nbytes <= most:
        yield batch
        return
    yield from pieces(batch.slice(0, n // 2), most)
    yield from pieces(batch.slice(n // 2), most)
