"""Spelling variants of a vocabulary, found over a reduced alphabet.

Every letter is hashed to one of a few symbols, so a word becomes a reduced word, and two words that differ by one
inserted, deleted or replaced letter have reduced words that differ by at most that. For each distinct reduced word its
whole neighbourhood of one edit is generated (itself, all deletions, replacements and insertions over the symbols, each
once) and joined to the reduced vocabulary; the words of a matched pair are then compared letter by letter.

Neighbours are polynomial digests of 64 bits, made from the digests of a reduced word's beginnings without writing the
neighbours out. Digests only bring words together: what decides is the comparison of the words, so a collision costs a
comparison and no result. Most neighbours are no reduced word of the vocabulary; a bit filter of the reduced vocabulary, of
a bounded size (``filter_bits``), keeps those where they are made. Beyond that size the filter lets more through and the
join does the same with more rows.

A word's form is the near word that is by far more frequent (``ratio``); as a form is at least ``ratio`` times as frequent
as its word, chains of forms are short, and roots come from doubling the step a few times.

Rows: a null text has no words; a null id deletes no letter; repeated rows count again; an empty table gives no words.
Runs of any length take part whole. Of the documents' columns only the id and the text are read, so others may have any
name. Ties of n between near words go to the smallest in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
SYMBOLS = 8
#: Of a run's ids one in so many loses a letter: the misspelling that the query's rule asks for.
ERROR_MODULUS = 31
#: Bits of the filter for each reduced word, and at most in all.
BITS_EACH, MOST_BITS = 16, 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Neighbours made at a time.
_STRIDE = 1 << 20
_PARTS = 64


def runs(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``docs``' ids with ``run``: each maximal run of letters of at least ``least``, A to Z in lower case; shorter runs can't give longer words."""
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    ascii_only = F.octet_length("run") == F.length("run")  # lower() reads these alone as A to Z, and faster
    lower = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", lower.alias("run"))


def with_errors(doc_id: Column, run: Column, modulus: int = ERROR_MODULUS) -> Column:
    """The run, without one letter where ``modulus`` divides the checksum of id and run; the checksum says which."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words in column ``word`` that are long and frequent enough; counts combine before the shuffle."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def symbols(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols from 1 of all letters of ``words`` one after another, the words' starts in them with the end)."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    return letters % np.uint64(size) + np.uint64(1), starts


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def reduced(words: list[str], size: int = SYMBOLS) -> np.ndarray:
    """The digest of each word's reduced word."""
    s, starts = symbols(words, size)
    out = np.zeros(len(words), np.uint64)
    if len(s):
        place = np.arange(len(s)) - np.repeat(starts[:-1], np.diff(starts))
        full = np.flatnonzero(np.diff(starts))
        out[full] = np.add.reduceat(s * _powers(int(place.max()))[place], starts[:-1][full])
    return out


def neighbourhoods(d: np.ndarray, size: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, digest) of the one-edit neighbourhoods of reduced words of one length, each neighbour of a word once.

    ``d``: a row of symbols (from 1) for each word. Of equal deletions the one at the end of its run of equal symbols
    stands, of equal insertions the one behind such a run.
    """
    n, length = d.shape
    power = _powers(length + 1)
    begin = np.zeros((n, length + 1), np.uint64)
    np.cumsum(d * power[:length], axis=1, out=begin[:, 1:])
    whole, rows = begin[:, -1], np.arange(n)
    yield rows, whole
    inverse, base = np.uint64(_INVERSE), np.uint64(_BASE)
    steps = np.arange(size + 1, dtype=np.uint64) * power[:, None]  # products modulo 2^64
    for k in range(length + 1):
        end = whole - begin[:, k]
        if k < length:
            last = rows if k == length - 1 else np.flatnonzero(d[:, k] != d[:, k + 1])
            yield last, begin[last, k] + (whole[last] - begin[last, k + 1]) * inverse
        for s in range(1, size + 1):
            other = rows if k == length else np.flatnonzero(d[:, k] != s)
            yield other, begin[other, k] + steps[k, s] + end[other] * base
            if k < length:
                yield other, whole[other] + (np.uint64(s) - d[other, k]) * power[k]


def _slots(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each digest, both in the part that its upper bits name."""
    each = np.uint64(bits // _PARTS - 1)
    mixed = (digests ^ (digests >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    part = (digests >> np.uint64(64 - _PARTS.bit_length() + 1)) * (each + np.uint64(1))
    return part + (mixed >> np.uint64(33) & each), part + (mixed & each)


def bit_filter(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` (a power of two) over column ``reduced``: its parts are made in tasks; together they are ``bits`` / 8 bytes, however large the vocabulary is."""
    each = bits // _PARTS

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, np.ndarray] = {}
        for pdf in batches:
            at = np.concatenate(_slots(pdf["reduced"].to_numpy().view(np.uint64), bits))
            for part in np.unique(at // np.uint64(each)).tolist():
                made.setdefault(part, np.zeros(each, bool))[(at[at // np.uint64(each) == part] - np.uint64(part * each)).astype(np.int64)] = True
        yield pd.DataFrame({"part": list(made), "packed": [np.packbits(m).tobytes() for m in made.values()]})

    by_part = vocabulary.select("reduced", F.shiftrightunsigned("reduced", 64 - _PARTS.bit_length() + 1).alias("part")).repartition(_PARTS, "part")
    out = np.zeros(bits // 8, np.uint8)
    for r in by_part.mapInPandas(pack, "part long, packed binary").collect():  # a row a part
        out[r.part * each // 8 : (r.part + 1) * each // 8] = np.frombuffer(r.packed, np.uint8)
    return out


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is far more than its bytes say, which would be put together into few tasks else."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def with_reduced(vocabulary: DataFrame, size: int = SYMBOLS) -> DataFrame:
    """``vocabulary`` with the digest of each word's reduced word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(reduced=reduced(pdf["word"].tolist(), size).view(np.int64))

    return vocabulary.mapInPandas(run, "word string, n long, reduced long")


def reduced_pairs(vocabulary: DataFrame, bits: int, size: int = SYMBOLS) -> DataFrame:
    """(reduced, other): the neighbourhood of each distinct reduced word, without most of those that the vocabulary has no word for."""
    sieve = vocabulary.sparkSession.sparkContext.broadcast(bit_filter(vocabulary, bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sieve.value
        for pdf in batches:
            words, own = pdf["word"].tolist(), pdf["reduced"].to_numpy()
            s, starts = symbols(words, size)
            lengths = np.diff(starts)
            for length in np.unique(lengths):
                every = np.flatnonzero(lengths == length)
                step = max(1, _STRIDE // max(1, length))
                for low in range(0, len(every), step):
                    at = every[low : low + step]
                    which, found, waiting = [], [], 0
                    for rows, digest in neighbourhoods(s[starts[at][:, None] + np.arange(length)], size):
                        a, b = _slots(digest, bits)
                        met = (held[a >> np.uint64(3)] >> (np.uint64(7) - (a & np.uint64(7))) & held[b >> np.uint64(3)] >> (np.uint64(7) - (b & np.uint64(7)))) & np.uint64(1) != 0
                        which.append(own[at[rows[met]]])
                        found.append(digest[met])
                        waiting += len(found[-1])
                        if waiting > _STRIDE:
                            yield pd.DataFrame({"reduced": np.concatenate(which), "other": np.concatenate(found).view(np.int64)})
                            which, found, waiting = [], [], 0
                    if waiting:
                        yield pd.DataFrame({"reduced": np.concatenate(which), "other": np.concatenate(found).view(np.int64)})

    one = vocabulary.groupBy("reduced").agg(F.min("word").alias("word"))
    return one.select("word", "reduced").repartition(_tasks(vocabulary)).mapInPandas(run, "reduced long, other long")


def near_words(vocabulary: DataFrame, size: int = SYMBOLS, most_bits: int = MOST_BITS) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words of a vocabulary (word, n) that differ by exactly one letter inserted, deleted or replaced."""
    words = stored(with_reduced(vocabulary, size))
    count = words.count()
    bits = min(most_bits, 1 << max(10, (BITS_EACH * count - 1).bit_length())) if count else 1 << 10
    pairs = reduced_pairs(words, bits, size)
    right = words.select(F.col("reduced").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = pairs.join(right, "other").repartition(_tasks(words), "reduced").join(words, "reduced")
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain of at most ``steps`` forms, by doubling the step."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, (steps - 1).bit_length())):
        at = stored(at)
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return at


def grouped(vocabulary: DataFrame, ratio: int = RATIO, size: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a vocabulary (word, n)."""
    words = stored(vocabulary)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    links = near_words(words, size).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.near_n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    known = stored(known.select("word", "n", "n_near", F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")))
    least, most = known.agg(F.min("n"), F.max("n")).first()
    steps, reach = 0, (least or 1) * ratio  # a chain multiplies n by the ratio at each step
    while most and reach <= most:
        steps, reach = steps + 1, reach * ratio
    ends = roots(known.where("form IS NOT NULL").select("word", "form"), steps)
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, ratio: int = RATIO, size: int = SYMBOLS) -> DataFrame:
    """The spelling variants of all words of ``docs``, some of whose runs lose a letter by the rule of ``with_errors``."""
    found = runs(docs).select(with_errors(F.col("doc_id"), F.col("run")).alias("word"))
    return grouped(vocabulary(found), ratio, size)
