"""Repeated windows of a fixed length over many documents: what the two exact substring operators share.

Documents are dealt into shards of a few MB by a hash of their text, so that copies meet. Texts whose copies hold many
characters are heavy: one row stands for all, grouped by the text itself, combined before the shuffle. A shard is worked
on as arrays of symbol hashes, in runs that a processor's cache can hold; a long text is cut into runs that overlap.

1. Every window has a minimiser: the least digest of its ``seed``-symbol substrings, the leftmost among equals. Equal
   windows have equal minimisers at equal offsets. Shards send the distinct minimisers, packed, to buckets, which answer
   which of them occur twice. Digests only sift: all that follows compares contents.
2. Consecutive windows of one minimiser are a context: the symbols that they cover together. Shards send the distinct
   contexts of recurring minimisers, and a bucket compares all contexts of a minimiser exactly (``contexts``).
3. Shards turn the answers into spans.

A minimiser of many different contexts, as in a line that many documents share, is hot. Its contexts first go through a
second sieve: their shards send digests of the windows to buckets of those, and only what recurs is left to compare.

A shard sends a minimiser or a context once however often it occurs there, so a hot passage is no hot key, and no pairs
are made. There are as many buckets as the characters need (``BUCKET_CHARS``), and a shard packs what goes to a bucket
into one row: there are never more rows than contexts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import stored

SHARD_CHARS = 4_000_000
LEAST_SHARDS = 48
#: Characters of the documents for each bucket of minimisers and of contexts.
BUCKET_CHARS, CONTEXT_CHARS = 64_000_000, 16_000_000
#: A text is heavy if its copies hold more characters than this; heavy texts are told by so many slots of a hash.
HEAVY, SLOTS = SHARD_CHARS // 16, 1 << 20
#: A minimiser is hot that has more places than this in a shard, or more shards than that (those of several places twice).
CROWD, SPREAD = 32, 64
#: Buckets of the answers that are no contexts': recurring minimisers, recurring windows of hot ones.
SEEDS, SIEVED = -1, -2

_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_32, _ONE = np.uint64(32), np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    high = x >> _32
    np.bitwise_xor(x, high, out=high)
    high *= _C
    high ^= high >> np.uint64(29)
    return high


def byte_grams(data: bytes) -> np.ndarray:
    """Digests of the 8-byte strings that start at each byte (the last seven: of what follows, padded)."""
    n = len(data)
    padded = data + bytes(16)
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        count = (n - o + 7) // 8
        out[o::8] = np.frombuffer(padded, "<u8", count, o)
    return mixed(out * _A)


def seed_length(length: int, gram: int) -> int:
    """Symbols of a minimiser: the largest power of two up to about a third of a window, ``gram`` at least."""
    return max(gram, 1 << (max(1, length // 3 + 2).bit_length() - 1))


class Windows:
    """The windows of ``length`` symbols of pieces of text that stand one after another.

    ``grams``: digests of the ``gram``-symbol strings at each place. ``ends``: where each piece ends.
    Windows that would cross an end are left out: ``valid`` tells which places begin a window.
    """

    def __init__(self, grams: np.ndarray, gram: int, ends: np.ndarray, length: int):
        n = len(grams)
        self.length = length
        self.seed = seed_length(length, gram)
        self.valid, self.least = np.zeros(n, bool), np.zeros(n, np.uint64)
        self.places, self.values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < length:
            return
        h, size = grams, gram
        while size < self.seed:
            longer = np.zeros(n, np.uint64)
            longer[: n - size] = h[: n - size] * _A + h[size:]
            h, size = mixed(longer), size * 2
        seeds = h | _ONE  # zero means none
        span = length - self.seed + 1
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        step = np.zeros(n + 1, np.int32)
        many = ends - begins >= length
        np.add.at(step, begins[many], 1)
        np.add.at(step, ends[many] - length + 1, -1)
        self.valid = np.cumsum(step[:n]) > 0
        self.least = np.where(self.valid, self._sliding(seeds, span, np.minimum), np.uint64(0))
        most = self._sliding(self.least[::-1], span, np.maximum)[::-1]
        self.places = np.flatnonzero((most == seeds) & (most > 0))
        self.values = seeds[self.places]

    @staticmethod
    def _sliding(x: np.ndarray, span: int, f: np.ufunc) -> np.ndarray:
        """f over x[i : i + span] (less at the end), in about log2(span) passes."""
        size, out = 1, x.copy()
        while size * 2 <= span:
            longer = out.copy()
            if len(x) > size:
                f(out[:-size], out[size:], out=longer[:-size])
            out, size = longer, size * 2
        if (rest := span - size) and len(x) > rest:
            longer = out.copy()
            f(out[:-rest], out[rest:], out=longer[:-rest])
            out = longer
        return out

    def contexts(self, recurring: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, windows, offset of the seed in the first, seed's digest) of the contexts whose seed is in ``recurring`` (sorted)."""
        at = np.zeros(0, np.int64)
        if len(recurring) and self.valid.any():
            change = np.flatnonzero(self.least[1:] != self.least[:-1]) + 1
            bounds = np.concatenate(([0], change, [len(self.least)]))
            at = np.flatnonzero(np.repeat(member(self.least[bounds[:-1]], recurring), np.diff(bounds)) & self.valid)
        least = self.least[at]
        k = np.searchsorted(self.places, at)
        wrong = np.arange(len(at))
        while len(wrong := wrong[self.values[k[wrong]] != least[wrong]]):
            k[wrong] += 1
        place = self.places[k]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        return at[first], np.diff(np.append(first, len(at))), (place - at)[first], least[first]


class Shard:
    """The windows of a shard's documents, made in runs that the processor's cache can hold; long documents in several.

    ``documents``: for each document its symbols; ``grams`` gives the digests of a list of pieces, joined.
    Places count from the shard's first symbol.
    """

    def __init__(self, documents: list, grams: Callable, gram: int, length: int, run: int = 1 << 16):
        sizes = np.array([len(d) for d in documents], np.int64)
        self.length, self.ends = length, np.cumsum(sizes)
        self.runs: list[tuple[np.ndarray, np.ndarray, Windows]] = []
        pieces, froms, held = [], [], 0

        def close() -> None:
            nonlocal pieces, froms, held
            if pieces:
                ends = np.cumsum([len(p) for p in pieces])
                self.runs.append((np.concatenate(([0], ends[:-1])), np.array(froms), Windows(grams(pieces), gram, ends, length)))
            pieces, froms, held = [], [], 0

        for document, n, end in zip(documents, sizes.tolist(), self.ends.tolist()):
            if n < length:
                continue
            for low in range(0, n - length + 1, run):  # a piece begins ``run`` windows
                piece = document[low : low + run + length - 1] if n > run else document
                if held and held + len(piece) > run:
                    close()
                pieces.append(piece)
                froms.append(end - n + low)
                held += len(piece)
        close()

    def values(self) -> np.ndarray:
        """The digests of all minimisers, one for each place of one."""
        found = [self._from(run, run[2].places) for run in self.runs]
        places, first = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_index=True)
        return np.concatenate([np.zeros(0, np.uint64), *(w.values for _, _, w in self.runs)])[first]

    @staticmethod
    def _from(run: tuple, local: np.ndarray) -> np.ndarray:
        starts, froms, _ = run
        piece = np.searchsorted(starts, local, "right") - 1
        return froms[piece] + local - starts[piece]

    def contexts(self, recurring: np.ndarray) -> tuple[np.ndarray, ...]:
        """As ``Windows.contexts``, over the whole shard."""
        parts = []
        for run in self.runs:
            at, count, offset, digest = run[2].contexts(recurring)
            parts.append((self._from(run, at), count, offset, digest))
        kinds = (np.int64, np.int64, np.int64, np.uint64)
        return tuple(np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate(kinds))


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (((mixed(x * _A) >> _32) * np.uint64(buckets)) >> _32).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) in bucket order: one stable radix pass over the digit."""
    order = np.argsort(bucket, kind="stable")
    digits = bucket[order]
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(digits)) + 1, [len(digits)])) if len(digits) else np.zeros(1, np.int64)
    for a, b in zip(bounds, bounds[1:]):
        yield int(digits[a]), order[a:b]


class Dealt(NamedTuple):
    """Documents as (id, text, none: whether it was null, c0, c1, ...: other columns), dealt out."""

    rows: DataFrame  # shard, id, text, none, copies, ...; one row for each heavy text, with its least id
    heavy: tuple[DataFrame, DataFrame] | None  # the documents of heavy texts with their digest; of (digest), first (least id) where there are copies
    shards: int
    buckets: int
    context_buckets: int


def dealt(docs: DataFrame, key: str, text: str, others: tuple[str, ...] | list[str] = ()) -> Dealt:
    """Documents by shard. Every text of which heavy copies are told apart from is compared by itself or its SHA-256."""
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{text}`").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    kind = F.xxhash64("text")
    kinds = stored(docs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
    chars = kinds.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, -(-chars // SHARD_CHARS))
    slots = stored(kinds.where((F.col("n") > 1) & (F.col("chars") > HEAVY)).select(F.pmod("kind", F.lit(SLOTS)).alias("slot")).distinct())
    light, heavy = docs.withColumn("copies", F.lit(1).cast("long")), None
    if not slots.isEmpty():
        marked = docs.join(F.broadcast(slots), F.pmod(kind, F.lit(SLOTS)) == F.col("slot"), "left")  # at most SLOTS rows
        alone = [c for c in docs.columns if c not in ("id", "text")]
        several = marked.where("slot IS NOT NULL").drop("slot")
        one = several.groupBy("text").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in alone])
        light = marked.where("slot IS NULL").drop("slot").withColumn("copies", F.lit(1).cast("long")).unionByName(one)
        firsts = one.where("copies > 1").select(F.sha2("text", 256).alias("of"), F.col("id").alias("first"))
        heavy = several.withColumn("digest", F.sha2("text", 256)), firsts
    rows = light.select(F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"), "*")
    return Dealt(rows, heavy, shards, max(LEAST_SHARDS, -(-chars // BUCKET_CHARS)), max(LEAST_SHARDS, -(-chars // CONTEXT_CHARS)))


def twice(rows: DataFrame) -> DataFrame:
    """(bucket, shard, found, hot): of each shard's packed digests those that occur twice or more anywhere, and the hot ones among them."""

    most = SPREAD

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        once, many, crowd = ([np.frombuffer(b, "<u8") for b in pdf[c]] for c in ("once", "many", "crowd"))
        values, counts = np.unique(np.concatenate((*once, *many, *many)), return_counts=True)
        repeated = values[counts > 1]
        hot = np.union1d(values[counts > most], np.concatenate(crowd))
        found = [np.union1d(a[member(a, repeated)], b).astype("<u8") for a, b in zip(once, many)]
        answers = {"found": [f.tobytes() for f in found], "hot": [f[member(f, hot)].tobytes() for f in found]}
        return pd.DataFrame({"bucket": pdf["bucket"], "shard": pdf["shard"], **answers})[[bool(len(f)) for f in found]]

    return rows.groupBy("bucket").applyInPandas(decide, FOUND)


PACKED = "bucket int, shard int, once binary, many binary, crowd binary"
FOUND = "bucket int, shard int, found binary, hot binary"


def packed(values: np.ndarray, copied: np.ndarray, buckets: int, shard: int) -> pa.Table:
    """A row for each bucket: the digests that occur once here, those that occur more often or are in ``copied``, and those of more than ``CROWD`` places."""
    out: dict[str, list] = {"bucket": [], "shard": [], "once": [], "many": [], "crowd": []}
    values, counts = np.unique(values, return_counts=True)
    several = (counts > 1) | member(values, np.unique(copied))
    for b, at in by_bucket(bucket_of(values, buckets)):
        out["bucket"].append(b)
        out["shard"].append(shard)
        for name, which in (("once", ~several[at]), ("many", several[at]), ("crowd", counts[at] > CROWD)):
            out[name].append(values[at][which].astype("<u8").tobytes())
    return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), (pa.int32(), pa.int32(), *[pa.binary()] * 3))})


def placed(seed: np.ndarray, hot: np.ndarray, buckets: int, shard: int) -> np.ndarray:
    """Buckets of contexts by their seeds; those of ``hot`` ones wait in a negative bucket of their shard's own."""
    return np.where(member(seed, hot), SIEVED - shard, bucket_of(seed, buckets))


def recurring_runs(count: np.ndarray, digests: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window there, windows) of the runs of windows whose digest is in ``kept``; ``digests`` of ``count[0]`` windows, then ``count[1]``, ..."""
    keep, start = member(digests, kept), np.cumsum(count) - count
    begins, ends = keep.copy(), keep.copy()
    begins[1:] &= ~keep[:-1]
    ends[:-1] &= ~keep[1:]
    begins[start], ends[start + count - 1] = keep[start], keep[start + count - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    owner = np.searchsorted(start, first, "right") - 1
    return owner, first - start[owner], last - first + 1


def sieved(sent: DataFrame, buckets: int, digests: Callable, part: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """(what is left to compare of the waiting contexts in ``sent``, digests of their recurring windows by shard).

    ``digests(row)`` gives those of a row's windows, and those of them that stand here twice; ``part(row, kept)`` its rows of
    ``schema``, cut to the windows that ``kept`` has. Both read ``sent`` by bucket, as its comparison does: one shuffle serves all.
    """

    def waiting(table: pa.Table) -> list[dict]:
        return table.to_pylist() if len(table) and table["bucket"][0].as_py() < 0 else []

    def pack(table: pa.Table) -> pa.Table:
        rows = [packed(*digests(row), buckets, row["shard"]) for row in waiting(table)]
        return pa.concat_tables(rows) if rows else packed(np.zeros(0, np.uint64), np.zeros(0, np.uint64), buckets, 0)

    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        kept = all_of(found["found"].to_pylist())
        rows = [part(row, kept) for row in waiting(table)] if len(kept) else []
        return pa.concat_tables(rows) if rows else table.slice(0, 0)

    kept = twice(sent.groupBy("bucket").applyInArrow(pack, PACKED)).withColumn("bucket", F.lit(SIEVED) - F.col("shard"))
    left = sent.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(cut, schema)
    return left, kept.withColumn("bucket", F.lit(SIEVED))


def all_of(blobs: list[bytes]) -> np.ndarray:
    """The sorted digests of packed arrays."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, "<u8") for b in blobs)]))


def covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that begins at one of the places ``at``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:n]) > 0
