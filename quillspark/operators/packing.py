"""WN17: chapters packed into word-budgeted segments.

A chapter is one row with its blocks in order, so its segments are made in one task without a shuffle; chapters run in
parallel. The fold looks ahead by one block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ABBREVIATIONS, OPENERS
from quillspark.sources.batches import pieces

#: Word budgets. Fixed values.
LEAST, TARGET, MOST, LEAD_IN, KEEP_DIALOGUE, SHORT_DIALOGUE, HARD_MOST = 150, 200, 250, 70, 12, 8, 300

_BREAK = re.compile(r"(?:\*\s*){3,}|---|___")
_GAP = re.compile("(?<=[.!?])\\s+(?=[" + OPENERS + "])")
_ABBREVIATED = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(ABBREVIATIONS) + r")\.$")
_CLAUSE = re.compile(r"(?<=[,;:—–])\s+")


def sentences(text: str) -> list[str]:
    """F8 on one text."""
    out, begin = [], 0
    for m in _GAP.finditer(text):
        if not _ABBREVIATED.search(text, max(begin, m.start() - 8), m.start()):
            out.append(text[begin : m.start()].strip())
            begin = m.end()
    return [s for s in [*out, text[begin:].strip()] if s]


def units(text: str, most: int = HARD_MOST) -> list[str]:
    """a text of at most ``most`` words as it is, else clauses filled greedily, and slices of longer clauses."""
    if len(text.split()) <= most:
        return [text]
    clauses = [c.strip() for c in _CLAUSE.split(text) if c.strip()]
    out: list[str] = []
    held: list[str] = []
    count = 0
    for clause in clauses:
        words = clause.split()
        if held and count + len(words) > most:
            out.append(" ".join(held))
            held, count = [], 0
        if len(words) > most:
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
        else:
            held.append(clause)
            count += len(words)
    return [*out, " ".join(held)] if held else out


def oversized_units(texts: DataFrame, most: int = HARD_MOST) -> DataFrame:
    """F9 over a table (doc_id, text): how many units each text has, the words of the largest, and a digest of them in order. Null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                made = [units(t, most) for t in part["text"].to_pylist()]
                numbers = [[len(u) for u in made], [max((len(x.split()) for x in u), default=0) for u in made]]
                digests = [hashlib.md5("\n".join(u).encode()).hexdigest() for u in made]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(n, pa.int64()) for n in numbers), pa.array(digests, pa.string())], ["doc_id", "n_units", "largest", "units_md5"])

    return texts.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, n_units long, largest long, units_md5 string")


@dataclass
class _Packer:
    done: list[tuple[str, bool]] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    words: int = 0
    lead_in: bool = True

    def emit(self, scene_break: bool = False) -> None:
        if self.held:
            self.done.append((" ".join(self.held), scene_break))
            self.held, self.words, self.lead_in = [], 0, False

    def limits(self) -> tuple[int, int, int]:
        return (1, LEAD_IN, LEAD_IN) if self.lead_in else (LEAST, TARGET, MOST)

    def add(self, unit: str, short: bool) -> None:
        n = len(unit.split())
        least, _, most = self.limits()
        if self.words + n > most and self.words >= least and not short or n >= HARD_MOST and self.words and not short:
            self.emit()
        self.held.append(unit)
        self.words += n
        if n >= HARD_MOST:
            self.emit()


def pack(blocks: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """(text, ends a scene) of each segment of a chapter, from its (type, text) blocks."""
    p = _Packer()
    for i, (kind, raw) in enumerate(blocks):
        text = raw.strip()
        if not text:
            continue
        if _BREAK.fullmatch(text):
            p.emit(scene_break=True)
            continue
        if kind == "heading":
            p.emit()
            p.done.append((text, False))
            continue
        for sentence in sentences(text):
            for unit in units(sentence):
                p.add(unit, kind == "dialogue" and len(unit.split()) < SHORT_DIALOGUE)
        _, target, most = p.limits()
        if i + 1 < len(blocks) and blocks[i + 1][0] == "dialogue":
            following = len(blocks[i + 1][1].split())
            if following < KEEP_DIALOGUE and p.words + following <= most:
                continue
        if p.words >= target:
            p.emit()
    p.emit()
    return p.done


COLUMNS = {"segment_index": "integer", "raw_text": "string", "n_words": "integer", "is_scene_break": "boolean"}


def segments(chapters: DataFrame) -> DataFrame:
    """One row a segment from rows with ``blocks`` array<struct<type, text>>; other columns are repeated."""
    kept = chapters.drop("blocks")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                owner, rows = [], []
                for at, blocks in enumerate(part["blocks"].to_pylist()):
                    made = pack([(b["type"] or "", b["text"] or "") for b in blocks or []])
                    owner += [at] * len(made)
                    rows += [(i, t, len(t.split()), s) for i, (t, s) in enumerate(made, 1)]
                given = part.select(names).take(pa.array(owner, pa.int64()))
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*given.columns, *made], [*names, *COLUMNS])

    schema = kept.schema
    for name, kind in COLUMNS.items():
        schema = schema.add(name, kind)
    return chapters.mapInArrow(run, schema)


def structured_book(chapters: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SS2: chapter rows with counts (failed without segments, else queued) and pending segment rows."""
    counts = packed.groupBy("chapter_id").agg(F.count("*").alias("n"))
    rows = chapters.drop("blocks").join(counts, "chapter_id", "left").withColumn("total_count", F.coalesce("n", F.lit(0))).drop("n")
    rows = rows.withColumn("status", F.when(F.col("total_count") == 0, "failed").otherwise("queued"))
    return rows, packed.withColumn("status", F.lit("pending"))
