"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation is a finite automaton over codepoint classes. Each class is a
function from state to state; the closure of those functions under composition
is a small monoid with a composition table. Texts become class arrays, an
associative scan over the functions (blocks composed side by side, then block
prefixes, then states inside blocks) gives the state before each character, and
one table says whether a slice begins there. Slices feed a cached pair merge by
rank; byte offsets of the ids are kept, so that any id range can be decoded.

The automaton stands for the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Rows: a null text encodes as the empty one, to no ids. Special tokens never
appear: their strings are ordinary text. ``encode`` and ``decode`` keep other
columns but for their own results (``ids``, ``offsets``, ``decoded``), which they
replace. Repeated rows are each encoded; a very long text is taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quillspark.llm.scratch import slices

RANKS = "byte_bpe_multi_50k.tiktoken"

# Classes of a character, as the automaton reads them.
LETTER, NUMBER, OTHER, APOSTROPHE_1, APOSTROPHE_2, SPACE_INNER, SPACE_LAST, BLANK_LAST, END = range(9)
# States, named after what the slice in progress holds.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, SUFFIX_1, SUFFIX_2 = range(8)
#: Characters that the pattern calls white space. Fixed values.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LONG_PIECE = 100
_NO_RANK = 1 << 40
_CACHE_LIMIT = 800_000
_WIDTH = 64


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE_INNER
    return table


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, states after each function, composition table, begins[state, class])."""
    goes = np.zeros((9, 8), np.uint8)
    begins = np.ones((8, 9), bool)
    fresh = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE_1: SUFFIX_1, APOSTROPHE_2: SUFFIX_2, SPACE_INNER: IN_BLANKS, SPACE_LAST: AFTER_SPACE, BLANK_LAST: FRESH, END: FRESH}
    for kind, state in fresh.items():
        goes[kind, :] = state

    def joins(state: int, kind: int, to: int) -> None:
        goes[kind, state], begins[state, kind] = to, False

    for state in (IN_LETTERS, AFTER_SPACE):
        joins(state, LETTER, IN_LETTERS)
    for state in (IN_NUMBERS, AFTER_SPACE):
        joins(state, NUMBER, IN_NUMBERS)
    for state in (IN_OTHERS, AFTER_SPACE):
        for kind in (OTHER, APOSTROPHE_1, APOSTROPHE_2):
            joins(state, kind, IN_OTHERS)
    joins(IN_BLANKS, SPACE_INNER, IN_BLANKS)
    for kind in range(END):
        joins(SUFFIX_2, kind, SUFFIX_1)
        joins(SUFFIX_1, kind, FRESH)
    functions = [tuple(range(8))]
    number = {functions[0]: 0}
    generators = []
    for kind in range(9):
        f = tuple(goes[kind])
        if f not in number:
            number[f] = len(functions)
            functions.append(f)
        generators.append(number[f])
    for f in functions:  # grows while it is read: the closure under composition
        for kind in range(9):
            h = tuple(goes[kind][s] for s in f)
            if h not in number:
                number[h] = len(functions)
                functions.append(h)
    table = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return np.array(generators, np.uint16), np.array(functions, np.uint8), table, begins


def _states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each character, by an associative scan over transition functions."""
    generators, functions, compose, _ = _automaton()
    n = len(kinds)
    blocks = -(-n // _WIDTH)
    padded = np.full(blocks * _WIDTH, END, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, _WIDTH).T)
    whole = generators[columns[0]]
    for column in columns[1:]:
        whole = compose[whole, generators[column]]
    prefix, step = whole.copy(), 1
    while step < blocks:
        longer = prefix.copy()
        longer[step:] = compose[prefix[:-step], prefix[step:]]
        prefix, step = longer, step * 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = functions[prefix[:-1], FRESH]
    steps = functions[generators]  # class x state
    before = np.empty((_WIDTH, blocks), np.uint8)
    for i, column in enumerate(columns):
        before[i] = state
        state = steps[column, state]
    return before.T.reshape(-1)[:n]


def slice_starts(texts: list[str]) -> list[np.ndarray]:
    """For each text, the character offsets where its slices begin."""
    if not texts:
        return []
    codes = np.frombuffer("".join(f"{t}\0" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths) - 1
    kinds = _classes()[codes]
    kinds[ends] = END
    blank = np.flatnonzero(kinds == SPACE_INNER)
    following = kinds[blank + 1]
    last = blank[(following != SPACE_INNER) & (following != END)]
    kinds[last] = np.where(codes[last] == 0x20, SPACE_LAST, BLANK_LAST)
    quote = np.flatnonzero(codes == 0x27)
    quote = quote[kinds[quote] == OTHER]
    if len(quote):
        one = codes[quote + 1]
        two = codes[np.minimum(quote + 2, len(codes) - 1)]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        kinds[quote[short]], kinds[quote[long]] = APOSTROPHE_1, APOSTROPHE_2
    starts = np.flatnonzero(_automaton()[3][_states_before(kinds), kinds] & (kinds != END))
    bounds = np.searchsorted(starts, ends)
    first = ends + 1 - lengths
    return [starts[a:b] - low for a, b, low in zip(np.concatenate(([0], bounds[:-1])), bounds, first)]


class Codec:
    """Encodes and decodes by a table of byte strings and ranks; merges are cached by slice, within a bound."""

    def __init__(self, name: str = RANKS):
        with open(public_tokenizers.path(name), "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.cached: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of least rank is joined first, the leftmost among equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) < _LONG_PIECE:
            bounds = list(range(len(piece) + 1))
            pairs = [ranks.get(piece[i : i + 2], _NO_RANK) for i in range(len(piece) - 1)]
            while pairs and (least := min(pairs)) < _NO_RANK:
                i = pairs.index(least)
                del bounds[i + 1], pairs[i]
                if i < len(pairs):
                    pairs[i] = ranks.get(piece[bounds[i] : bounds[i + 2]], _NO_RANK)
                if i:
                    pairs[i - 1] = ranks.get(piece[bounds[i - 1] : bounds[i + 1]], _NO_RANK)
            return [ranks[piece[i:j]] for i, j in zip(bounds, bounds[1:])]
        n = len(piece)  # linked slices and a heap: n log n for slices of any length
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, as little-endian unsigned 32-bit integers."""
        out, cached = [], self.cached
        for a, b in slices(texts):
            for text, starts in zip(texts[a:b], slice_starts(texts[a:b])):
                if len(cached) > _CACHE_LIMIT:
                    cached.clear()
                bounds = [*starts.tolist(), len(text)]
                pieces = [text[i:j] for i, j in zip(bounds, bounds[1:])]
                try:
                    ids = [cached[p] for p in pieces]
                except KeyError:
                    for p in pieces:
                        if p not in cached:
                            cached[p] = np.array(self.merge(p.encode("utf-8", "replace")), "<u4").tobytes()
                    ids = [cached[p] for p in pieces]
                out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the text; the last entry is the text's length in bytes."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def codec(name: str = RANKS) -> Codec:
    """One codec a worker process."""
    return Codec(name)


def encode(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``docs`` with ``ids`` array<long> and ``offsets`` array<long> (bytes before each id, and in all); no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks)
        for pdf in batches:
            ids = c.encode_batch([t if isinstance(t, str) else "" for t in pdf[text]])
            yield pdf.assign(ids=[i.astype(np.int64) for i in ids], offsets=[c.offsets(i) for i in ids])

    docs = docs.drop("ids", "offsets")
    return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(LongType())), StructField("offsets", ArrayType(LongType()))]))


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded`` binary from its ``ids`` (null: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks)
        for pdf in batches:
            yield pdf.assign(decoded=[b"" if i is None else c.decode(np.asarray(i, np.int64)) for i in pdf["ids"]])

    encoded = encoded.drop("decoded")
    return encoded.mapInPandas(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def round_trip(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass over the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(ranks)
        for pdf in batches:
            ids = c.encode_batch([t if isinstance(t, str) else "" for t in pdf["text"]])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(c.decode(i)).hexdigest() for i in ids],
            })

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
