"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into whole windows and a rest, a rest
longer than ``piece_limit`` into pieces of at most that. Whole windows stand
alone. Pieces are numbered as they are written and dealt by a hash of the number
into groups of about ``group_pieces``, so that no id or text makes a group large;
in a group every rest starts as a partial partition with one filled window, and
the two partial partitions with the largest imbalance are merged again and again,
the fullest window of one with the emptiest of the other, until one partition is
left. Its windows are nearly equal. The window count starts at the least that
could do and rises whenever a window exceeds the capacity.

Rows: a null text is an empty one and still has its end id. Repeated rows are
packed each, null ids too; an empty table gives no pieces. A text that writes one
of the vocabulary's own marks out gets the mark's id, as the tokenizer reads it.
"""

from __future__ import annotations

import heapq
import itertools
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm.scratch import stored

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 1024
PIECE_LIMIT = 1024
_CACHE_LIMIT = 400_000
#: How the vocabulary's own marks begin. Fixed value.
MARK = "<|"


class WordEncoder:
    """Whole-text encoding by the tokenizer, whose words (it never joins across blanks) are cached, within a bound."""

    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.cached: dict[str, bytes] = {"": b""}
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.as_characters = {b: 256 + i for i, b in enumerate(hidden)}  # byte-level BPE writes other bytes as these

    def _word(self, word: str) -> bytes:
        """Ids of one run of letters below U+0250 by the tokenizer's model alone, after its own normalisation."""
        shown = word.lower()
        if not shown.isascii():
            shown = shown.encode().decode("latin-1").translate(self.as_characters)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(shown)])

    def _learn(self, words: list[str]) -> None:
        """Cache the ids of words; letters before one full stop or comma are encoded apart, as the tokenizer splits there."""
        cached, plain, marked = self.cached, {}, []
        for w in words:
            if w.isalpha() and (w.isascii() or max(w) < "\u0250" and w.lower().isalpha()):
                cached[w] = self._word(w)
                continue
            stem = w[:-1]
            if w[-1] in ".," and stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
                marked.append(w)
                if stem not in cached:
                    if stem.isascii() or max(stem) < "\u0250":
                        cached[stem] = self._word(stem)
                    else:
                        plain[stem] = None
                if w[-1] not in cached:
                    plain[w[-1]] = None
            else:
                plain[w] = None
        fresh = list(plain)
        for low in range(0, len(fresh), 2000):
            some = fresh[low : low + 2000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            ids = np.array(e.ids, "<u4").tobytes()
            bounds = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), np.append(starts, 1 << 40)).tolist()
            for w, i, j in zip(some, bounds, bounds[1:]):
                cached[w] = ids[4 * i : 4 * j]
        for w in marked:
            cached[w] = cached[w[:-1]] + cached[w[-1]]

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if MARK in text:  # may hold one of the tokenizer's own marks, which it finds across words
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")  # the tokenizer reads lower case
        cached = self.cached
        try:
            return b"".join([cached[w] for w in words])
        except KeyError:
            if len(cached) > _CACHE_LIMIT:
                cached.clear()
                cached[""] = b""
            self._learn([w for w in dict.fromkeys(words) if w not in cached])
            return b"".join([cached[w] for w in words])


@cache
def encoder(name: str = VOCABULARY) -> WordEncoder:
    """One encoder a worker process."""
    return WordEncoder(name)


def cuts(length: int, capacity: int = CAPACITY, piece_limit: int = PIECE_LIMIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then a rest in pieces of nearly equal length."""
    whole = length // capacity
    out = [(i * capacity, capacity) for i in range(whole)]
    rest, at = length - whole * capacity, whole * capacity
    for left in range(-(-rest // piece_limit), 0, -1):
        size = -(-(length - at) // left)
        out.append((at, size))
        at += size
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, piece_limit: int = PIECE_LIMIT, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` if asked for; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = (e.encode(text) if isinstance(text, str) else b"") + end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, piece_limit):
                    part = ids[start * 4 : (start + length) * 4]
                    rows.append((doc_id, start, length, zlib.crc32(part), n, *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window (0 to windows - 1) of each size, by multiway differencing with opposing imbalances merged."""
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    parent = np.arange(n)
    tick = itertools.count()
    heap: list[tuple] = [(-int(s), next(tick), i, None, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def opened(entry: tuple) -> tuple[np.ndarray, np.ndarray]:
        spread, _, i, loads, members = entry
        if loads is None:
            loads, members = np.zeros(windows, np.int64), np.full(windows, -1)
            loads[0], members[0] = -spread, i
        return loads, members

    while len(heap) > 1:
        a, ma = opened(heapq.heappop(heap))
        b, mb = opened(heapq.heappop(heap))
        loads, other = a + b[::-1], mb[::-1]
        both = (ma >= 0) & (other >= 0)
        parent[other[both]] = ma[both]
        members = np.where(ma >= 0, ma, other)
        order = np.argsort(-loads, kind="stable")
        loads, members = loads[order], members[order]
        loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), next(tick), -1, loads, members))
    _, members = opened(heap[0])
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    window = np.full(n, -1)
    filled = members >= 0
    window[members[filled]] = np.arange(windows)[filled]
    return window[parent]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none above ``capacity``; the number of windows rises until that holds."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        if np.bincount(window, sizes, minlength=1).max(initial=0) <= capacity:
            return window
        windows += 1


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, piece_limit: int = PIECE_LIMIT, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with ``sequence_id`` and its ``offset`` there.

    Only the lengths are shuffled. Numbers are the group's number times 2^32, and the window's place in the group.
    """
    cut = stored(pieces(docs, capacity, piece_limit).withColumn("number", F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("dealt", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("long")).drop("number")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        size = pdf["length"].to_numpy()
        whole = int((size == capacity).sum())
        window = np.concatenate((np.arange(whole), whole + pack(size[whole:], capacity)))
        pdf = pdf.assign(sequence_id=(pdf["dealt"].to_numpy() << 32) + window).sort_values("sequence_id", kind="stable")
        before = pdf["length"].cumsum() - pdf["length"]
        pdf["offset"] = before - before.groupby(pdf["sequence_id"]).transform("first")
        return pdf.drop(columns="dealt")

    schema = cut.drop("number").schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("dealt").applyInPandas(place, schema)
