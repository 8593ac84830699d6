"""Exact substring dedup by a depth-limited radix sort of suffixes.

Suffixes are sorted by their first ``length`` bytes only, most significant digit
first, and a group that has shrunk to one suffix is dropped at once; what is
still grouped at full depth are exactly the repeated windows. The first digit of
a suffix is its window's minimiser: suffixes of a digit that occurs once are
dropped without being moved. The others go to the bucket of their digit, those
of one minimiser together as one context, so that a byte is sent about four
times instead of ``length`` times. There the passes go on over the bytes, eight
at a time, from the minimiser on and before it (``contexts``), down to the full
depth: groups are equal byte by byte.

Every byte that a repeated window covers is removed, from all its places.

Rows: a null text is empty. Ids may be of any type, null and repeated; each row
is answered. Windows never cross documents. Copies of a text of ``length`` bytes
or more are repeated as a whole. Other columns, whatever their names, are kept
by ``without_repeats`` and left out by ``dedup_digest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.contexts import byte_order, chunks, classes
from quillspark.llm.windows import PACKED, SEEDS, SIEVED, Shard, all_of, bucket_of, by_bucket, byte_grams, covered, dealt, packed, placed, recurring_runs, seed_length, sieved, twice

LENGTH = 200
CONTEXTS = "bucket int, shard int, seeds binary, offsets binary, counts binary, many binary, body binary"


class Texts:
    """A shard's distinct texts as bytes, in their own order, their windows, and which of them have copies.

    The answers are bits by place, and a shuffle's rows come in any order each time they are read.
    """

    def __init__(self, table: pa.Table, length: int):
        self.rows = table
        texts = table["text"].to_pylist()
        copies: dict[str, int] = {}
        for text, n in zip(texts, table["copies"].to_pylist()):
            copies[text] = copies.get(text, 0) + n
        ordered = sorted(copies)
        places = {t: i for i, t in enumerate(ordered)}
        self.row_text = [places[t] for t in texts]
        self.parts = [t.encode("utf-8", "replace") for t in ordered]
        self.copied = np.array([copies[t] for t in ordered]) > 1
        self.length = length
        self.windows = Shard(self.parts, lambda some: byte_grams(b"".join(some)), 8, length)
        self.shard = table["shard"][0].as_py() if len(table) else 0

    def minimisers(self, buckets: int) -> pa.Table:
        """Packed minimisers; those of texts with copies recur."""
        copied = [p for p, c in zip(self.parts, self.copied) if c]
        again = Shard(copied, lambda some: byte_grams(b"".join(some)), 8, self.length).values() if copied else np.zeros(0, np.uint64)
        return packed(self.windows.values(), again, buckets, self.shard)

    def contexts(self, recurring: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """(first window, windows, offset, seed, number of the distinct context) of every context, and of the distinct ones (bucket, first place among all, whether it occurs twice)."""
        at, count, offset, seed = self.windows.contexts(recurring)
        data = b"".join(self.parts)
        known: dict[tuple, int] = {}
        tail = self.length - 1
        number = np.array([known.setdefault((o, data[a : a + c + tail]), len(known)) for a, c, o in zip(at.tolist(), count.tolist(), offset.tolist())], np.int64)
        document = np.searchsorted(self.windows.ends, at, "right")
        weight = np.bincount(number, 1 + self.copied[document].astype(np.int64), minlength=len(known)) if len(number) else np.zeros(0)
        first = np.unique(number, return_index=True)[1]
        return at, count, offset, seed, number, placed(seed[first], hot, buckets, self.shard), first, weight > 1


def _rows(shard: int, bucket: np.ndarray, seed: np.ndarray, offset: np.ndarray, count: np.ndarray, many: np.ndarray, body: list[bytes]) -> pa.Table:
    """Contexts as a row for each bucket."""
    out: dict[str, list] = {name: [] for name in ("bucket", "shard", "seeds", "offsets", "counts", "many", "body")}
    for b, some in by_bucket(bucket):
        values = (b, shard, seed[some].astype("<u8").tobytes(), offset[some].astype("<u4").tobytes(), count[some].astype("<u4").tobytes(), many[some].astype("u1").tobytes(), b"".join([body[i] for i in some.tolist()]))
        for name, value in zip(out, values):
            out[name].append(value)
    return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), [pa.int32(), pa.int32(), *[pa.binary()] * 5])})


def send(texts: Texts, recurring: np.ndarray, hot: np.ndarray, buckets: int) -> pa.Table:
    """The shard's distinct contexts, a row for each bucket."""
    at, count, offset, seed, _, bucket, first, many = texts.contexts(recurring, hot, buckets)
    data, tail = b"".join(texts.parts), texts.length - 1
    body = [data[a : a + c + tail] for a, c in zip(at[first].tolist(), count[first].tolist())]
    return _rows(texts.shard, bucket, seed[first], offset[first], count[first], many, body)


def _opened(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(seeds, offsets, counts, many, bodies) of a sent row."""
    seed, offset, count = np.frombuffer(row["seeds"], "<u8"), np.frombuffer(row["offsets"], "<u4").astype(np.int64), np.frombuffer(row["counts"], "<u4").astype(np.int64)
    size = count + length - 1
    body = [row["body"][e - n : e] for e, n in zip(np.cumsum(size).tolist(), size.tolist())]
    return seed, offset, count, np.frombuffer(row["many"], "u1"), body


def window_digests(body: list[bytes], count: np.ndarray, length: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(b[i : i + length]) for b, c in zip(body, count.tolist()) for i in range(c)), np.uint64, int(count.sum()))


def _digests(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, count, many, body = _opened(row, length)
    found = window_digests(body, count, length)
    return found, found[np.repeat(many > 0, count)]


def _part(row: dict, kept: np.ndarray, length: int, buckets: int) -> pa.Table:
    """A waiting row's contexts, cut to the windows whose digest is in ``kept``, in buckets behind all others."""
    seed, offset, count, many, body = _opened(row, length)
    of, skip, n = recurring_runs(count, window_digests(body, count, length), kept)
    cut = [body[i][a : a + k + length - 1] for i, a, k in zip(of.tolist(), skip.tolist(), n.tolist())]
    return _rows(row["shard"], buckets + bucket_of(seed[of], buckets), seed[of], offset[of] - skip, n, many[of], cut)


def repeated_in(seed: np.ndarray, offset: np.ndarray, count: np.ndarray, weight: np.ndarray, body: list[bytes], length: int) -> np.ndarray:
    """For the windows of distinct contexts, one context after another: which of them stand in ``weight`` two or more."""
    starts = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), bool)
    by = np.argsort(seed, kind="stable")
    before = max(8, -(-(length - seed_length(length, 8)) // 8) * 8)
    whole = -(-length // 8) * 8
    for part in chunks(seed[by]):
        rows = by[part]
        if len(rows) == 1 and weight[rows[0]] < 2:
            continue
        data = np.frombuffer(b"".join([body[i] for i in rows.tolist()]), np.uint8)
        o, k, w = offset[rows], count[rows], weight[rows]
        size = k + length - 1
        at = np.cumsum(size) - size + o  # of the seeds
        right, left = np.arange(whole), np.arange(before)
        ahead = np.where(right < (size - o)[:, None], data[np.minimum(at[:, None] + right, len(data) - 1)], np.uint8(0))
        behind = np.where(left < o[:, None], data[np.maximum(at[:, None] - 1 - left, 0)], np.uint8(0))
        for who, window, group in classes(byte_order(behind), byte_order(ahead), o, k, length):
            _, back, total = np.unique(group, return_inverse=True, return_counts=True)
            total = np.bincount(back, w[who], minlength=len(total))
            out[starts[rows[who]] + window] = total[back] > 1
    return out


def decide(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """(bucket, shard, found: a bit for each window of the contexts that the shard sent, in order)."""
    known: dict[tuple, int] = {}
    numbers, seeds, offsets, counts, weights, bodies, answers = [], [], [], [], [], [], []
    pdf = pdf[pdf["bucket"] >= 0]  # the others wait for the second sieve
    for row in pdf.to_dict("records"):
        mine = []
        seed, offset, count, many, sent = _opened(row, length)
        for s, o, c, m, body in zip(seed.tolist(), offset.tolist(), count.tolist(), many.tolist(), sent):
            i = known.setdefault((s, o, body), len(known))
            if i == len(weights):
                seeds.append(s)
                offsets.append(o)
                counts.append(c)
                weights.append(0)
                bodies.append(body)
            weights[i] += 1 + m
            mine.append(i)
        numbers.append(np.array(mine, np.int64))
    count = np.array(counts, np.int64)
    bits = repeated_in(np.array(seeds, np.uint64), np.array(offsets, np.int64), count, np.array(weights, np.int64), bodies, length)
    start = np.cumsum(count) - count
    for mine in numbers:
        answers.append(np.packbits(bits[spread(start[mine], count[mine])]).tobytes())
    return pd.DataFrame({"bucket": pdf["bucket"], "shard": pdf["shard"], "found": answers})


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def removed_bytes(rows, length: int, finish: Callable, schema: str) -> DataFrame:
    """``finish(rows, texts, which bytes go, for each text)`` over the shards of ``dealt`` documents."""
    shards, buckets, wide = rows.rows, rows.buckets, rows.context_buckets

    def minimisers(table: pa.Table) -> pa.Table:
        return Texts(table, length).minimisers(buckets)

    def candidates(table: pa.Table, seeds: pa.Table) -> pa.Table:
        return send(Texts(table, length), all_of(seeds["found"].to_pylist()), all_of(seeds["hot"].to_pylist()), wide)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = Texts(table, length)
        given = answers.to_pydict()
        recurring, hot, kept = (all_of([f for b, f in zip(given["bucket"], given[c]) if b == which]) for c, which in (("found", SEEDS), ("hot", SEEDS), ("found", SIEVED)))
        at, count, _, seed, number, bucket, first, _ = texts.contexts(recurring, hot, wide)
        found = {b: f for b, f in zip(given["bucket"], given["found"]) if b >= 0}
        sizes = count[first]
        start = np.cumsum(sizes) - sizes
        bits = np.zeros(int(sizes.sum()), bool)
        for b, some in by_bucket(bucket):
            if b >= 0:
                where = spread(start[some], sizes[some])
                bits[where] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=len(where)).astype(bool)
                continue
            data, rows = b"".join(texts.parts), first[some]
            body = [data[a : a + c + length - 1] for a, c in zip(at[rows].tolist(), count[rows].tolist())]
            of, skip, n = recurring_runs(count[rows], window_digests(body, count[rows], length), kept)
            for late, runs in by_bucket(wide + bucket_of(seed[rows][of], wide)):
                where = spread(start[some][of[runs]] + skip[runs], n[runs])
                bits[where] = np.unpackbits(np.frombuffer(found[late], np.uint8), count=len(where)).astype(bool)
        hit = bits[spread(start[number], count)]
        gone = covered(spread(at, count)[hit], length, int(texts.windows.ends[-1]) if texts.parts else 0)
        ends = texts.windows.ends.tolist()
        return finish(table, texts, [gone[e - len(p) : e] for p, e in zip(texts.parts, ends)])

    seeds = twice(shards.groupBy("shard").applyInArrow(minimisers, PACKED))
    sent = shards.groupBy("shard").cogroup(seeds.groupBy("shard")).applyInArrow(candidates, CONTEXTS)
    left, kept = sieved(sent, buckets, lambda row: _digests(row, length), lambda row, kept: _part(row, kept, length, wide), CONTEXTS)
    found = [some.groupBy("bucket").applyInPandas(lambda pdf: decide(pdf, length), "bucket int, shard int, found binary").withColumn("hot", F.lit(None).cast("binary")) for some in (sent, left)]
    answers = found[0].unionByName(found[1]).unionByName(seeds.withColumn("bucket", F.lit(SEEDS))).unionByName(kept)
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(remove, schema)


def _kept(part: bytes, gone: np.ndarray, whole: bool) -> bytes:
    if whole or not gone.any():
        return b"" if whole else part
    return np.frombuffer(part, np.uint8)[~gone].tobytes()


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def dedup_digest(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = dealt(docs, key, text)

    def finish(table: pa.Table, texts: Texts, gone: list[np.ndarray]) -> pa.Table:
        made = []
        for part, g, copied in zip(texts.parts, gone, texts.copied):
            n = len(part)
            whole = bool(copied) and n >= length
            spans = int(whole) if whole or not n else int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0])
            made.append((n, n if whole else int(g.sum()), spans, hashlib.sha256(_kept(part, g, whole)).hexdigest()))
        own = [i for i, c in enumerate(table["copies"].to_pylist()) if c == 1]
        out = [made[texts.row_text[i]] for i in own]
        columns = {"id": table["id"].take(pa.array(own, pa.int64()))} | {name: pa.array([r[k] for r in out], t) for k, (name, t) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))}
        return pa.table(columns)

    kind = rows.rows.schema["id"].dataType.simpleString()
    out = removed_bytes(rows, length, finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if rows.heavy is not None:
        n = F.octet_length("text").cast("long")
        goes = n >= length
        small = rows.heavy[0].select("id", "digest", n.alias("n_bytes"), F.when(goes, n).otherwise(0).alias("n_removed"), goes.cast("long").alias("n_spans"), F.when(goes, F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"))
        out = out.unionByName(small.join(rows.heavy[1], F.col("digest") == F.col("of")).drop("digest", "of", "first"))
    return out.withColumnRenamed("id", key)


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; halves of a character that a cut leaves go too.

    Rows that had text and lose all of it but white space are left out.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    rows = dealt(docs, key, text, others)

    def finish(table: pa.Table, texts: Texts, gone: list[np.ndarray]) -> pa.Table:
        kept = []
        for part, g, copied in zip(texts.parts, gone, texts.copied):
            whole = bool(copied) and len(part) >= length
            left = _kept(part, g, whole).decode("utf-8", "ignore")
            kept.append(None if (whole or g.any()) and not left.strip() else left)
        own = [i for i, c in enumerate(table["copies"].to_pylist()) if c == 1 and kept[texts.row_text[i]] is not None]
        out = table.take(pa.array(own, pa.int64()))
        return out.set_column(out.schema.get_field_index("text"), "text", pa.array([kept[texts.row_text[i]] for i in own], pa.string())).drop_columns(["shard", "copies"])

    out = removed_bytes(rows, length, finish, _fields(rows.rows.drop("shard", "copies")))
    if rows.heavy is not None:
        short = rows.heavy[0].where(F.octet_length("text") < length)
        out = out.unionByName(short.join(rows.heavy[1].select("of"), F.col("digest") == F.col("of")).drop("digest", "of"))
    names = {key: "id", text: "text"} | {c: f"c{i}" for i, c in enumerate(others)}
    back = {c: F.col(n).alias(c) for c, n in names.items()} | {text: F.when(~F.col("none"), F.col("text")).alias(text)}
    return out.select(*[back[c] for c in docs.columns])
