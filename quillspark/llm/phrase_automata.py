"""Substring dedup with repeated-phrase automata.

A passage of ``length`` words that also begins earlier (smaller id, or the same
document before) is removed. Recurring passages are confirmed first: shards send
the contexts of their recurring minimisers as words, and a bucket compares them
word by word (``windows``, ``contexts``): it answers which windows stand more
than once anywhere, and which shard holds the first of each. Confirmed windows
that follow one another are a passage. Each shard of documents compiles its own
Aho-Corasick automaton of just the passages confirmed in it, and streams its
documents through it, words joined by one space: a hit is an occurrence of all
windows of a passage. All occurrences go but the first of each window.

So a document is streamed once, through an automaton whose size its shard's text
bounds; a phrase that a third of all documents share is sent once a shard.
Digests only sift: what is removed was compared as words.

Rows: a null text has no words. Ids may be of any type; rows with a null id count
as later than all others. Rows of one id are ordered by their text in a shard,
by shard else. Nothing is removed from texts of fewer words than a window; of
copies of a text all but the first go whole. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillspark.llm.contexts import chunks, classes, radix_order
from quillspark.llm.scratch import stored
from quillspark.llm.suffix_radix import spread
from quillspark.llm.word_hash import word_digests
from quillspark.llm.windows import PACKED, SEEDS, SIEVED, Shard, all_of, bucket_of, by_bucket, covered, dealt, packed, placed, recurring_runs, seed_length, sieved, twice

LENGTH = 20
_LAST = np.iinfo(np.int64).max
CONTEXTS = "bucket int, shard int, seeds binary, offsets binary, counts binary, many binary, orders binary, places binary, body binary"
ANSWERS = "bucket int, shard int, found binary, firsts binary, hot binary"


def digests_of(documents: list[bytes], run: int = 1 << 18) -> list[np.ndarray]:
    """For each text the digests of its words, made for many texts at once, and for pieces of a long one. They only sift."""

    def made(some: list[bytes]) -> list[np.ndarray]:
        start, _, digest = word_digests(np.frombuffer(b"\n".join([*some, b""]), np.uint8))
        return np.split(digest, np.searchsorted(start, np.cumsum([len(d) + 1 for d in some]))[:-1])

    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for d in documents:
        if group and held + len(d) > run:
            out += made(group)
            group, held = [], 0
        if len(d) > run:
            words = d.split()
            out.append(np.concatenate([np.zeros(0, np.uint64), *(made([b" ".join(words[a : a + 4096])])[0] for a in range(0, len(words), 4096))]))
        else:
            group.append(d)
            held += len(d)
    return out + made(group) if group else out


class Words:
    """A shard's distinct texts in order of their least id, their words one after another, and the windows of those."""

    def __init__(self, table: pa.Table, length: int):
        self.rows, self.length = table, length
        orders = [_LAST if i is None else i for i in table["id"].to_pylist()]
        texts, copies = table["text"].to_pylist(), table["copies"].to_pylist()
        least: dict[str, tuple] = {}
        for row, (order, text, n) in enumerate(zip(orders, texts, copies)):
            best, of, many = least.get(text, (order, row, 0))
            least[text] = (*min((best, of), (order, row)), many + n)
        self.texts = sorted(least, key=lambda t: (least[t][0], t))
        self.orders = np.array([least[t][0] for t in self.texts], np.int64)
        self.first_rows = [least[t][1] for t in self.texts]
        self.copied = np.array([least[t][2] > 1 for t in self.texts], bool)
        at = {t: i for i, t in enumerate(self.texts)}
        self.row_text = [at[t] for t in texts]
        self.digests = digests_of([t.encode("utf-8", "replace") for t in self.texts])
        self.ends = np.cumsum([0, *map(len, self.digests)])[1:]
        self.windows = Shard(self.digests, np.concatenate, 1, length)
        self.shard = table["shard"][0].as_py() if len(table) else 0

    @cached_property
    def words(self) -> list[bytes]:
        return [w for t in self.texts for w in t.encode("utf-8", "replace").split()]

    def minimisers(self, buckets: int) -> pa.Table:
        """Packed minimisers; those of texts with copies recur."""
        copied = [d for d, c in zip(self.digests, self.copied) if c]
        again = Shard(copied, np.concatenate, 1, self.length).values() if copied else np.zeros(0, np.uint64)
        return packed(self.windows.values(), again, buckets, self.shard)

    def passage(self, begin: int, windows: int) -> bytes:
        """The words of so many windows from a place on, joined by one space."""
        return b" ".join(self.words[begin : begin + windows + self.length - 1])

    def contexts(self, recurring: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """(first window, windows, offset, seed, bucket, whether it occurs twice) of the distinct contexts, each at its first place."""
        at, count, offset, seed = self.windows.contexts(recurring)
        known: dict[tuple, int] = {}
        number = np.array([known.setdefault((o, self.passage(a, c)), len(known)) for a, c, o in zip(at.tolist(), count.tolist(), offset.tolist())], np.int64)
        document = np.searchsorted(self.ends, at, "right")
        weight = np.bincount(number, 1 + self.copied[document].astype(np.int64), minlength=len(known)) if len(number) else np.zeros(0)
        first = np.unique(number, return_index=True)[1]
        return at[first], count[first], offset[first], seed[first], placed(seed[first], hot, buckets, self.shard), weight > 1

    def occurrences(self, passages: set[bytes]) -> np.ndarray:
        """Places of all windows of these passages, found by one automaton over the documents, their words joined by one space."""
        if not passages:
            return np.zeros(0, np.int64)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in passages:
            automaton.add_word(f" {p.decode('latin-1')} ", p.count(b" ") + 1)  # a letter for each byte
        automaton.make_automaton()
        found: list[np.ndarray] = []
        begin = 0
        for end in self.ends.tolist():
            if end - begin >= self.length:
                words = self.words[begin:end]
                hits = np.array(list(automaton.iter(f" {b' '.join(words).decode('latin-1')} ")), np.int64).reshape(-1, 2)
                if len(hits):
                    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # of the space behind each word
                    last = np.searchsorted(stops, hits[:, 0])
                    found.append(spread(begin + last + 1 - hits[:, 1], hits[:, 1] - self.length + 1))
            begin = end
        return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def _rows(shard: int, bucket: np.ndarray, seed: np.ndarray, offset: np.ndarray, count: np.ndarray, many: np.ndarray, order: np.ndarray, place: np.ndarray, body: list[bytes]) -> pa.Table:
    """Contexts as a row for each bucket."""
    out: dict[str, list] = {name: [] for name in ("bucket", "shard", "seeds", "offsets", "counts", "many", "orders", "places", "body")}
    for b, some in by_bucket(bucket):
        values = [v[some].astype(t).tobytes() for v, t in ((seed, "<u8"), (offset, "<u4"), (count, "<u4"), (many, "u1"), (order, "<i8"), (place, "<i8"))]
        for name, value in zip(out, (b, shard, *values, b"\n".join([body[i] for i in some.tolist()]))):
            out[name].append(value)
    return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), [pa.int32(), pa.int32(), *[pa.binary()] * 7])})


def send(words: Words, recurring: np.ndarray, hot: np.ndarray, buckets: int) -> pa.Table:
    """The shard's distinct contexts as words, a row for each bucket."""
    at, count, offset, seed, bucket, many = words.contexts(recurring, hot, buckets)
    order = words.orders[np.searchsorted(words.ends, at, "right")] if len(at) else np.zeros(0, np.int64)
    return _rows(words.shard, bucket, seed, offset, count, many, order, at + offset, [words.passage(a, c) for a, c in zip(at.tolist(), count.tolist())])


def _opened(row: dict) -> tuple:
    """(seeds, offsets, counts, many, orders, places) of a sent row, and the bodies."""
    values = [np.frombuffer(row[c], t) for c, t in (("seeds", "<u8"), ("offsets", "<u4"), ("counts", "<u4"), ("many", "u1"), ("orders", "<i8"), ("places", "<i8"))]
    return *(v if v.dtype == np.uint64 else v.astype(np.int64) for v in values), row["body"].split(b"\n")


def window_digests(body: list[bytes], length: int) -> np.ndarray:
    """Digests of the windows of passages."""
    found = []
    for words in (b.split(b" ") for b in body):
        found += [xxhash.xxh64_intdigest(b" ".join(words[i : i + length])) for i in range(len(words) - length + 1)]
    return np.array(found, np.uint64)


def _digests(row: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, count, many, _, _, body = _opened(row)
    found = window_digests(body, length)
    return found, found[np.repeat(many > 0, count)]


def _part(row: dict, kept: np.ndarray, length: int, buckets: int) -> pa.Table:
    """A waiting row's contexts, cut to the windows whose digest is in ``kept``, in buckets behind all others."""
    seed, offset, count, many, order, place, body = _opened(row)
    of, skip, n = recurring_runs(count, window_digests(body, length), kept)
    cut = [b" ".join(body[i].split(b" ")[a : a + k + length - 1]) for i, a, k in zip(of.tolist(), skip.tolist(), n.tolist())]
    return _rows(row["shard"], buckets + bucket_of(seed[of], buckets), seed[of], offset[of] - skip, n, many[of], order[of], place[of], cut)


def decide(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """(bucket, shard, found and firsts: a bit for each window of the contexts that the shard sent, in order)."""
    known: dict[tuple, int] = {}
    seeds, offsets, counts, weights, bodies, owners, sent = [], [], [], [], [], [], []
    pdf = pdf[pdf["bucket"] >= 0]  # the others wait for the second sieve
    for number, row in enumerate(pdf.to_dict("records")):
        *values, body_of = _opened(row)
        mine = []
        for j, (s, o, c, m, order, place, body) in enumerate(zip(*(v.tolist() for v in values), body_of)):
            i = known.setdefault((s, o, body), len(known))
            owner = (order, row["shard"], place, number, j)
            if i == len(weights):
                seeds.append(s)
                offsets.append(o)
                counts.append(c)
                weights.append(0)
                bodies.append(body)
                owners.append(owner)
            weights[i] += 1 + m
            owners[i] = min(owners[i], owner)
            mine.append(i)
        sent.append(np.array(mine, np.int64))
    seed, offset, count, weight = np.array(seeds, np.uint64), np.array(offsets, np.int64), np.array(counts, np.int64), np.array(weights, np.int64)
    rank = np.empty(len(owners), np.int64)
    rank[sorted(range(len(owners)), key=owners.__getitem__)] = np.arange(len(owners))
    start = np.cumsum(count) - count
    repeated, first = np.zeros(int(count.sum()), bool), np.zeros(int(count.sum()), bool)
    by = np.argsort(seed, kind="stable")
    before = length - seed_length(length, 1)
    for part in chunks(seed[by]):
        rows = by[part]
        if len(rows) == 1 and weight[rows[0]] < 2:
            continue
        names: dict[bytes, int] = {}
        data = np.array([names.setdefault(w, len(names)) for i in rows.tolist() for w in bodies[i].split(b" ")], np.int64)
        o, k, w, r = offset[rows], count[rows], weight[rows], rank[rows]
        size = k + length - 1
        at = np.cumsum(size) - size + o
        right, left = np.arange(length), np.arange(max(before, 1))
        ahead = np.where(right < (size - o)[:, None], data[np.minimum(at[:, None] + right, len(data) - 1)], -1)
        behind = np.where(left < o[:, None], data[np.maximum(at[:, None] - 1 - left, 0)], -1)
        for who, window, group in classes(radix_order(behind), radix_order(ahead), o, k, length):
            _, back = np.unique(group, return_inverse=True)
            total = np.bincount(back, w[who])
            least = np.full(len(total), len(rank))
            np.minimum.at(least, back, r[who])
            repeated[start[rows[who]] + window] = total[back] > 1
            first[start[rows[who]] + window] = least[back] == r[who]
    found, firsts = [], []
    for number, mine in enumerate(sent):
        where = spread(start[mine], count[mine])
        owns = np.repeat([owners[i][3:] == (number, j) for j, i in enumerate(mine.tolist())], count[mine]).astype(bool)
        found.append(np.packbits(repeated[where]).tobytes())
        firsts.append(np.packbits(first[where] & owns).tobytes())
    return pd.DataFrame({"bucket": pdf["bucket"], "shard": pdf["shard"], "found": found, "firsts": firsts, "hot": None})


def removed_words(rows, length: int, finish: Callable, schema: str) -> DataFrame:
    """``finish(words, which words go, for each text)`` over the shards of ``dealt`` documents."""
    shards, buckets, wide = rows.rows, rows.buckets, rows.context_buckets

    def minimisers(table: pa.Table) -> pa.Table:
        return Words(table, length).minimisers(buckets)

    def candidates(table: pa.Table, seeds: pa.Table) -> pa.Table:
        return send(Words(table, length), all_of(seeds["found"].to_pylist()), all_of(seeds["hot"].to_pylist()), wide)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table, length)
        given = answers.to_pydict()
        recurring, hot, kept = (all_of([f for b, f in zip(given["bucket"], given[c]) if b == which]) for c, which in (("found", SEEDS), ("hot", SEEDS), ("found", SIEVED)))
        at, count, _, seed, bucket, _ = words.contexts(recurring, hot, wide)
        found = {b: (f, g) for b, f, g in zip(given["bucket"], given["found"], given["firsts"]) if b >= 0}
        start = np.cumsum(count) - count
        repeated, first = np.zeros(int(count.sum()), bool), np.zeros(int(count.sum()), bool)

        def take(b: int, where: np.ndarray) -> None:
            for bits, packed_bits in zip((repeated, first), found[b]):
                bits[where] = np.unpackbits(np.frombuffer(packed_bits, np.uint8), count=len(where)).astype(bool)

        for b, some in by_bucket(bucket):
            if b >= 0:
                take(b, spread(start[some], count[some]))
                continue
            body = [words.passage(a, c) for a, c in zip(at[some].tolist(), count[some].tolist())]
            of, skip, n = recurring_runs(count[some], window_digests(body, length), kept)
            for late, runs in by_bucket(wide + bucket_of(seed[some][of], wide)):
                take(late, spread(start[some][of[runs]] + skip[runs], n[runs]))
        places = spread(at, count)
        edge = np.ones(len(places), bool)  # a passage: repeated windows of a context that follow one another
        edge[1:] = ~repeated[:-1]
        edge[start] = True
        begins = np.flatnonzero(repeated & edge)
        ends = np.flatnonzero(repeated & np.append(edge[1:] | ~repeated[1:], True)[: len(places)])
        passages = {words.passage(a, b - a + 1) for a, b in zip(places[begins].tolist(), places[ends].tolist())}
        hits = words.occurrences(passages)
        later = hits[~np.isin(hits, places[first & repeated])]
        gone = covered(later, length, len(words.words))
        return finish(words, np.split(gone, words.ends[:-1]) if len(words.ends) else [])

    seeds = twice(shards.groupBy("shard").applyInArrow(minimisers, PACKED))
    sent = shards.groupBy("shard").cogroup(seeds.groupBy("shard")).applyInArrow(candidates, CONTEXTS)
    left, kept = sieved(sent, buckets, lambda row: _digests(row, length), lambda row, kept: _part(row, kept, length, wide), CONTEXTS)
    found = [some.groupBy("bucket").applyInPandas(lambda pdf: decide(pdf, length), ANSWERS) for some in (sent, left)]
    none = F.lit(None).cast("binary").alias("firsts")
    answers = found[0].unionByName(found[1]).unionByName(seeds.select(F.lit(SEEDS).alias("bucket"), "shard", "found", none, "hot")).unionByName(kept.select("bucket", "shard", "found", none, "hot"))
    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(remove, schema)


def _deduplicated(docs: DataFrame, length: int, key: str, text: str, kept: str, value: Callable, of_text: Callable[[Column], Column]) -> DataFrame:
    """(key, n_words, n_removed, ``kept``); ``value`` makes the last of the kept bytes, ``of_text`` of a column of them."""
    kind = docs.schema[key].dataType
    ranks = None
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    if not isinstance(kind, IntegralType):  # numbers in the order of the ids
        ranks = stored(docs.select("id").where("id IS NOT NULL").distinct().orderBy("id").withColumn("rank", F.monotonically_increasing_id()))
        named = docs.join(ranks, "id").select(F.col("rank").alias("id"), "text")
        docs = named.unionByName(docs.where("id IS NULL").select(F.lit(None).cast("long").alias("id"), "text"))
    rows = dealt(docs.withColumn("id", F.col("id").cast("long")), "id", "text")

    def finish(words: Words, gone: list[np.ndarray]) -> pa.Table:
        judged = []
        for end, g in zip(words.ends.tolist(), gone):
            some = words.words[end - len(g) : end]
            left = [w for w, x in zip(some, g.tolist()) if not x] if g.any() else some
            judged.append((len(g), int(g.sum()), value(b" ".join(left))))
        out = []
        for row, at in enumerate(words.row_text):
            n = judged[at][0]
            out.append(judged[at] if row == words.first_rows[at] or n < length else (n, n, value(b"")))
        columns = {"id": words.rows["id"]} | {name: pa.array([r[i] for r in out], t) for i, (name, t) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), (kept, pa.string())))}
        return pa.table(columns)

    out = removed_words(rows, length, finish, f"id long, n_words long, n_removed long, `{kept}` string")
    if rows.heavy is not None:
        n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        goes = F.col("n_words") >= length
        short = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
        copies = rows.heavy[0].select("id", "digest", n.alias("n_words"), "text").select("id", "digest", "n_words", F.when(goes, F.col("n_words")).otherwise(0).alias("n_removed"), of_text(F.when(goes, "").otherwise(short)).alias(kept))
        copies = copies.join(rows.heavy[1], F.col("digest") == F.col("of"))
        each = copies.groupBy("digest", "id").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("n_removed").alias("n_removed"), F.first(kept).alias(kept), F.first(F.col("id").eqNullSafe(F.col("first"))).alias("is_first"))
        later = each.withColumn("n", F.col("n") - F.col("is_first").cast("long")).where("n > 0")
        out = out.unionByName(later.select("id", "n_words", "n_removed", kept, F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col"))
    if ranks is not None:
        out = out.join(ranks.withColumnRenamed("id", "name"), F.col("id") == F.col("rank"), "left").drop("id", "rank").withColumnRenamed("name", "id")
    return out.select(F.col("id").cast(kind).alias(key), "n_words", "n_removed", kept)


def dedup_digest(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256."""
    return _deduplicated(docs, length, key, text, "kept_sha256", lambda kept: hashlib.sha256(kept).hexdigest(), lambda kept: F.sha2(kept, 256))


def kept_texts(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_text: the kept words joined by one space."""
    return _deduplicated(docs, length, key, text, "kept_text", lambda kept: kept.decode("utf-8", "replace"), lambda kept: kept)
