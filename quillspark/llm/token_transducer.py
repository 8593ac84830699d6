"""Token counts by finite transducers compiled from a tokenizer's vocabulary.

Two deterministic transducers stand one behind the other. The first reads classes of letters and says where the
tokenizer's pieces begin (runs of letters, single digits, runs of other signs, English endings behind an apostrophe). It has
six states; texts are cut into chunks, the map from the state before a chunk to that behind it is made for all chunks side by
side, and the maps are composed by a prefix scan, which gives every chunk its first state.

The second reads a piece's bytes and annotates each transition with the number of tokens that it adds (fewer tokens than
before may stand behind a byte, so it can be negative). It rests on a property of merges by rank: of a piece's beginning the
last token is the one that ends there, and stands behind the last token of the shorter beginning without a merge across the
two. A state is what that rule can still ask for: of each place from which a token may yet reach further, the part of the
token read so far, the last token before it, and the tokens counted since. States and transitions are compiled where they
are first met and kept, within a bound; the walk is the same over all pieces of a batch at once, a byte of each at a time.

Rows: a null text is an empty one with no tokens; repeated rows count each; an empty table gives an empty result. The strings
of the vocabulary's own marks count one token each, as the library reads them. Only the id and the text are read, so
other columns may have any name. A text is held by one task whole; the arrays over its letters are made for about
2^19 letters at a time (a run without a blank stays whole).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame

from quillspark.llm.scratch import slices

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Letters in a chunk of the first transducer, and at most in a batch.
CHUNK, BATCH = 1024, 1 << 19
#: States that a worker keeps at most between batches.
MOST_STATES = 150_000
#: Pieces walked side by side at least; fewer are walked one by one.
FEW = 24

# Classes of letters, after lower-casing. Those that an English ending needs stand alone.
_ENDING = "stmdrvle"
BLANK, QUOTE, DIGIT, SIGN, LETTER = range(5)
CLASSES = 5 + len(_ENDING)
FREE, IN_WORD, IN_SIGNS, QUOTED, QUOTED_RV, QUOTED_L = range(6)
STATES = 6
#: White space as the tokenizer's patterns read it. Fixed values.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Capitals that the library knows and Python's tables of 3.13 don't. Fixed values.
NEWER_CAPITALS = {0xA7CB: 0x0264, 0xA7DC: 0x019B}


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower case of every code point, class of every code point)."""
    lower = np.arange(0x110000, dtype=np.uint32)
    kind = np.full(0x110000, SIGN, np.uint8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))[0]
        if group == "L":
            kind[c] = LETTER
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif group == "N":
            kind[c] = DIGIT
            lower[c] = ord(chr(c).lower())
        elif group == "S":
            lower[c] = ord(chr(c).lower())
    for c, small in NEWER_CAPITALS.items():
        lower[c] = small
    kind[SPACES] = BLANK
    kind[ord("'")] = QUOTE
    kind[[ord(c) for c in _ENDING]] = 5 + np.arange(len(_ENDING))
    return lower, kind


@cache
def piece_transducer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, whether a piece begins at the letter, whether one began at the letter before) by state and class."""
    step, here, before = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), bool), np.zeros((STATES, CLASSES), bool)
    fresh = {BLANK: FREE, QUOTE: QUOTED, DIGIT: FREE, SIGN: IN_SIGNS}
    for state in range(STATES):
        for c in range(CLASSES):
            step[state, c] = fresh.get(c, IN_WORD)
            here[state, c] = c != BLANK
            before[state, c] = state in (QUOTED_RV, QUOTED_L)
    letters = range(LETTER, CLASSES)
    here[IN_WORD, letters] = False
    for state in (IN_SIGNS, QUOTED):  # signs and quotes go on
        step[state, [QUOTE, SIGN]], here[state, [QUOTE, SIGN]] = IN_SIGNS, False
    at = {c: 5 + i for i, c in enumerate(_ENDING)}
    for c, then in {**dict.fromkeys("stmd", FREE), "r": QUOTED_RV, "v": QUOTED_RV, "l": QUOTED_L}.items():
        step[QUOTED, at[c]], here[QUOTED, at[c]] = then, False
    here[QUOTED_RV, letters] = here[QUOTED_L, letters] = False  # the run began at the letter before
    for state, c in ((QUOTED_RV, "e"), (QUOTED_L, "l")):
        step[state, at[c]], before[state, at[c]] = FREE, False
    return step, here, before


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (a row each) of two neighbouring chunks as one."""
    return np.take_along_axis(then, first, axis=1)


def scanned(maps: np.ndarray) -> np.ndarray:
    """For each chunk the map of all chunks before and with it, by log-many steps of composition."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = compose(out[:-reach], out[reach:])
        reach *= 2
    return out


def piece_starts(kind: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each letter; ``kind``: the letters' classes, a blank last."""
    step, here, before = piece_transducer()
    chunks = -(-len(kind) // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[: len(kind)] = kind
    by_step = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    flat = step.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for c in by_step:
        maps = flat[maps.astype(np.uint16) * CLASSES + c[:, None]]
    state = np.zeros(chunks, np.uint8)
    state[1:] = scanned(maps)[:-1, FREE]
    seen = np.empty((CHUNK, chunks), np.uint16)
    for k, c in enumerate(by_step):
        seen[k] = state * np.uint16(CLASSES) + c
        state = flat[seen[k]]
    seen = seen.T.ravel()[: len(kind)]
    starts = here.ravel()[seen]
    starts[:-1] |= before.ravel()[seen[1:]]
    return starts


class MergeTransducer:
    """The second transducer; symbols are bytes, those that end a piece 256 higher."""

    def __init__(self, name: str = VOCABULARY):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            made = json.load(f)
        vocab = made["model"]["vocab"]
        self.marks = [t["content"] for t in made["added_tokens"]]
        end = made["model"]["end_of_word_suffix"]
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        spelt: dict[int, tuple[int, ...]] = {}  # a token's symbols
        for b in range(256):
            letter = chr(b) if b in shown else chr(256 + hidden.index(b))
            spelt[vocab[letter]], spelt[vocab[letter + end]] = (b,), (b + 256,)
        self.rank, self.parts = dict.fromkeys(spelt, -1), {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(made["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.merges[left, right] = rank
            self.rank[token], self.parts[token] = rank, (left, right)
            spelt[token] = spelt[left] + spelt[right]
        self.child: dict[int, int] = {}  # (node, symbol) of the tree of all tokens
        self.token = [-1]
        for token, its in spelt.items():
            node = 0
            for s in its:
                key = node << 9 | s
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = token
        self.inner = {key >> 9 for key in self.child}
        self.edges: dict[tuple[int, int], list[int]] = {}
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first, that before a piece."""
        start = (0, -1, 0)
        self.states, self.number = [start], {start: 0}
        self.keys, self.values, self.used = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0
        self.fits.clear()

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at a token's end (side 1) or beginning (0) while it grows, smallest first."""
        if (token, side) not in self.edges:
            out = [token]
            while out[-1] in self.parts:
                out.append(self.parts[out[-1]][side])
            self.edges[token, side] = out[::-1]
        return self.edges[token, side]

    def fit(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart: no merge across them comes before each has taken its next shape. On equal ranks the left one goes first."""
        known = self.fits.get(a << 20 | b)
        if known is not None:
            return known
        left, right, i, j, never = self.edge(a, 1), self.edge(b, 0), 0, 0, len(self.merges)
        while True:
            until_left = self.rank[left[i + 1]] if i + 1 < len(left) else never
            until_right = self.rank[right[j + 1]] if j + 1 < len(right) else never
            across = self.merges.get((left[i], right[j]), never)
            if across < until_left and across <= until_right and across < never:
                known = False
                break
            if until_left == until_right == never:
                known = True
                break
            i, j = (i + 1, j) if until_left <= until_right else (i, j + 1)
        self.fits[a << 20 | b] = known
        return known

    def compiled(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens added) of one transition."""
        held, child, token = self.states[state], self.child, self.token
        grown, last, added = [], None, 0
        for at in range(0, len(held), 3):
            node, behind, since = held[at : at + 3]
            node = child.get(node << 9 | symbol)
            if node is None:
                continue
            if last is None and token[node] >= 0 and (behind < 0 or self.fit(behind, token[node])):
                last, added = token[node], 1 - since
            grown.append((node, behind, since))
        if symbol >= 256:
            return 0, added
        new = []
        for node, behind, since in grown:
            if node in self.inner:
                new += (node, behind, since + added)
        new = (*new, 0, last, 0)
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number, added

    # Transitions stand in an open table: key state * 512 + symbol, value next state * 256 + tokens added + 128.

    def _put(self, keys: list[int], values: list[int]) -> None:
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = [*self.keys[old].tolist(), *keys], [*self.values[old].tolist(), *values]
            size = 1 << (4 * len(keys) - 1).bit_length()
            self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        key, value = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._home(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            self.keys[slot], self.values[slot] = key[free[first]], value[free[first]]
            left = np.ones(len(key), bool)
            left[free[first]] = False
            self.used += len(first)
            key, value, at = key[left], value[left], at[left] + 1 & len(self.keys) - 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def steps(self, key: np.ndarray) -> np.ndarray:
        """The values of transitions; those not yet met are compiled."""
        at = self._home(key)
        found = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero(found != key)
        while len(open_):
            absent = found[open_] < 0
            if absent.any():
                new = np.unique(key[open_[absent]]).tolist()
                made = [self.compiled(k >> 9, k & 511) for k in new]
                self._put(new, [n << 8 | d + 128 for n, d in made])
                at = self._home(key)  # the table may have grown
                found, out = self.keys[at], self.values[at]
                open_ = np.flatnonzero(found != key)
                continue
            at[open_] = at[open_] + 1 & len(self.keys) - 1
            found[open_], out[open_] = self.keys[at[open_]], self.values[at[open_]]
            open_ = open_[found[open_] != key[open_]]
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the pieces ``data[start:end]`` (bytes), none of them empty."""
        if len(self.states) > MOST_STATES:
            self.clear()
        order = np.argsort(start - end, kind="stable")  # the longest first: those still going are a beginning of all
        at, length = start[order], (end - start)[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, k = len(at), 0
        while live > FEW:
            symbol = data[at[:live] + k] + 256 * (length[:live] == k + 1)
            value = self.steps(state[:live] << 9 | symbol)
            state[:live] = value >> 8
            total[:live] += (value & 255) - 128
            k += 1
            live = int(np.searchsorted(-length, -k))
        for i in range(live):
            here = int(state[i])
            piece = data[at[i] + k : at[i] + length[i]].tolist()
            piece[-1] += 256
            known: dict[int, tuple[int, int]] = {}
            added = 0
            for s in piece:
                key = here << 9 | s
                step = known.get(key)
                if step is None:
                    step = known[key] = self.compiled(here, s)
                here, d = step
                added += d
            total[i] += added
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


@cache
def transducer(name: str = VOCABULARY) -> MergeTransducer:
    """One a worker process."""
    return MergeTransducer(name)


def stretches(text: str, size: int = BATCH) -> Iterator[str]:
    """A text in stretches of about ``size`` letters that end with a blank: a blank brings both transducers to their first states. A run without a blank stays whole."""
    low = 0
    while len(text) - low > size:
        cut = max(text.rfind(b, low, low + size) for b in " \n")
        if cut < low:
            cut = min((at for b in " \n" if (at := text.find(b, low + size)) >= 0), default=len(text) - 1)
        yield text[low : cut + 1]
        low = cut + 1
    yield text[low:]


def count_batch(texts: list[str], name: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text."""
    t = transducer(name)
    out = np.zeros(len(texts), np.int64)
    marks = re.compile("|".join(map(re.escape, sorted(t.marks, key=len, reverse=True))) or r"(?!)")
    parts, owner, held = [], [], 0
    for i, text in enumerate(texts):
        for some in stretches(text):
            cut = marks.split(some)
            out[i] += len(cut) - 1
            for s in cut:
                parts.append(s if s.isascii() else unicodedata.normalize("NFC", s).replace("\u0130", "i\u0307"))
                owner.append(i)
            held += len(some)
            if held > BATCH:
                _add(parts, owner, t, out)
                parts, owner, held = [], [], 0
    _add(parts, owner, t, out)
    return out


def _add(parts: list[str], owner: list[int], t: MergeTransducer, out: np.ndarray) -> None:
    """Add the tokens of ``parts`` to those of their texts."""
    if not parts:
        return
    lower, kind = letter_tables()
    small = lower[np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le"), np.uint32)]
    kinds = kind[small]
    starts = piece_starts(kinds)
    begin, end, data = _pieces(small, kinds, starts)
    if len(begin):
        text_of = np.repeat(np.array(owner), [len(p) + 1 for p in parts])[starts]
        out += np.bincount(text_of, t.counts(data, begin, end), len(out)).astype(np.int64)


def _pieces(small: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, behind the last byte, all bytes) of the pieces of lower-case letters that end with a blank."""
    stop = np.flatnonzero(starts | (kind == BLANK))
    first = np.flatnonzero(starts)
    last = stop[np.searchsorted(stop, first, side="right")]
    place = np.concatenate(([0], np.cumsum(1 + (small >= 0x80) + (small >= 0x800) + (small >= 0x10000))))
    return place[first], place[last], np.frombuffer(small.tobytes().decode("utf-32-le").encode(), np.uint8)


def token_counts(docs: DataFrame, limit: int = LIMIT, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, where it is read; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            counted = np.zeros(len(texts), np.int64)
            for low, high in slices(texts, BATCH):
                counted[low:high] = count_batch(texts[low:high], name)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counted, "over_limit": counted > limit})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
