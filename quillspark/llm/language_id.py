"""Language identification with hyperdimensional profiles.

A letter is a random vector of +1 and -1, drawn from its code point. An n-gram
of three letters is bound by permuting (rotating) the first letter's vector
twice and the second's once and multiplying the three. A document is the bundle
(sum) of its n-gram vectors, a language the bundle of its training documents'
unit vectors, and a document gets the language whose prototype has the largest
cosine with it.

Rows: a null text, or one without a letter, is ``und`` with score 0. Ties go to
the alphabetically first language. With no training rows every document is
``und``. Repeated rows are scored one by one; other columns play no part, and
``predict`` keeps them but for its own results, ``lang_pred`` and ``score``, which
it replaces. Very long texts are taken whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import slices

DIMS = 1024
UNDETERMINED = "und"
#: Expected number of training documents; drawn evenly by a hash of the id where more are labelled.
TRAIN_ROWS = 20_000
_BLOCK = 4096
_SCALE = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """One row of +1 and -1 for each code point: the bits of a 64-bit mixing function."""
    words = np.arange(dims // 64, dtype=np.uint64)
    x = codes.astype(np.uint64)[:, None] * np.uint64(dims // 64) + words[None, :] + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def document_vectors(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """The bundled n-gram vectors of whole texts, one float32 row each; all zero where there is no letter."""
    out = np.zeros((len(texts), dims), np.float32)
    if not texts:
        return out
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    codes = np.concatenate(parts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in parts])
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, doc = codes[keep], doc[keep]
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    at, size = place[codes], len(alphabet)
    inner = codes[1:-1] != 32
    grams = ((at[:-2] * size + at[1:-1]) * size + at[2:])[inner]
    owner = doc[1:-1][inner]
    if not len(grams):
        return out
    if size <= 256:
        seen = np.zeros(size**3, bool)
        seen[grams] = True
        vocabulary = np.flatnonzero(seen)
        rank = np.zeros(size**3, np.int32)
        rank[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
        grams = rank[grams]
    else:
        vocabulary, grams = np.unique(grams, return_inverse=True)
    third = letter_vectors(alphabet, dims)
    second, first = np.roll(third, 1, axis=1), np.roll(third, 2, axis=1)
    for low in range(0, len(vocabulary), _BLOCK):
        block = vocabulary[low : low + _BLOCK]
        bound = first[block // (size * size)] * second[block // size % size] * third[block % size]
        mine = slice(None) if len(vocabulary) <= _BLOCK else (grams >= low) & (grams < low + len(block))
        cell = owner[mine] * np.int64(len(block)) + grams[mine] - low
        counts = np.bincount(cell, minlength=len(texts) * len(block)).reshape(len(texts), len(block))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = TRAIN_ROWS, dims: int = DIMS) -> dict[str, np.ndarray]:
    """Language prototypes from rows with text and language.

    About ``train_rows`` rows are drawn by a hash of ``key`` (all, if there are fewer). Their unit vectors are summed
    as integers on the executors, so that the result doesn't depend on the order; the driver gets one vector a language.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    total = rows.count()
    share = min(1.0, train_rows / total) if total else 1.0
    rows = rows.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            texts, langs = pdf[text].tolist(), pdf[lang].to_numpy()
            for a, b in slices(texts):
                unit = np.rint(_unit(document_vectors(texts[a:b], dims)) * _SCALE).astype(np.int64)
                for name in set(langs[a:b]):
                    sums[name] = sums.get(name, 0) + unit[langs[a:b] == name].sum(axis=0)
        for name, total in sums.items():
            yield pd.DataFrame({"lang": name, "dim": np.arange(dims, dtype=np.int32), "weight": total})

    sums = rows.select(text, F.col(lang).cast("string").alias(lang)).mapInPandas(bundle, "lang string, dim int, weight long").groupBy("lang", "dim").agg(F.sum("weight").alias("weight"))
    out: dict[str, np.ndarray] = {}
    for row in sums.collect():  # languages x dimensions, whatever the number of documents
        out.setdefault(row.lang, np.zeros(dims))[row.dim] = row.weight
    return {name: v / (np.linalg.norm(v) or 1.0) for name, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the cosine, at least 0) from whole texts; no shuffle."""
    names = np.array([*prototypes, UNDETERMINED], dtype=object)
    dims = len(next(iter(prototypes.values()), np.zeros(DIMS)))
    matrix = np.array([*prototypes.values()], np.float32).reshape(len(prototypes), dims)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            best, score = np.full(len(texts), len(matrix)), np.zeros(len(texts))
            for a, b in slices(texts) if len(matrix) else ():
                vectors = _unit(document_vectors(texts[a:b], dims))
                cosine = vectors @ matrix.T
                known = np.abs(vectors).any(axis=1)
                best[a:b] = np.where(known, cosine.argmax(axis=1), len(matrix))
                score[a:b] = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0)
            yield pdf.assign(lang_pred=names[best], score=score.astype(float))

    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    return docs.drop("lang_pred", "score").mapInPandas(classify, schema)


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows that aren't held out."""
    prototypes = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), prototypes).drop("text")
