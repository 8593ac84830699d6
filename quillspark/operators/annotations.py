"""Annotation cleaning: JSON beats coerced, clamped and aligned; dictionary substitution; voice contexts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits and neutral values. Fixed values.
MAX_BEATS, MAX_TEXT, MAX_FIELD, MAX_SUMMARY = 12, 4000, 500, 2000
STYLE, EMOTION, INTENSITY, PACE = "warm neutral storyteller", "steady narrative flow", 0.3, "normal"
SUMMARY = "A scene in the book."
_LOWER = {c: c + 32 for c in range(65, 91)}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column, path: str, limit: int) -> Column:
    at = F.variant_get(v, path, "variant")
    return F.when(_kind(at) == "STRING", F.substring(F.try_variant_get(v, path, "string"), 1, limit))


def neutral(text: Column) -> Column:
    return F.struct(text.alias("text"), F.struct(F.lit(STYLE).alias("style"), F.lit(EMOTION).alias("emotion"), F.lit(INTENSITY).alias("intensity"), F.lit(PACE).alias("pace")).alias("delivery"))


def _beat(v: Column) -> Column:
    raw = F.variant_get(v, "$.delivery.intensity", "variant")
    number = F.when(_kind(raw).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$.delivery.intensity", "double"))
    number = F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)
    pace = _string(v, "$.delivery.pace", MAX_FIELD)
    delivery = F.struct(
        F.coalesce(_string(v, "$.delivery.style", MAX_FIELD), F.lit(STYLE)).alias("style"), F.coalesce(_string(v, "$.delivery.emotion", MAX_FIELD), F.lit(EMOTION)).alias("emotion"),
        F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).otherwise(INTENSITY).alias("intensity"), F.when(pace.isin("slow", "normal", "fast"), pace).otherwise(PACE).alias("pace"))
    return F.struct(_string(v, "$.text", MAX_TEXT).alias("text"), delivery.alias("delivery"))


def cleaned(rows: DataFrame, json: str = "annotated_json", text: str = "raw_text") -> DataFrame:
    """``rows`` with ``scene_summary`` and ``beats`` from an object or a bare array; a neutral beat on the text where no valid beat is."""
    v = F.try_parse_json(json)
    kind = F.coalesce(_kind(v), F.lit(""))
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$.beats", "array<variant>"))
    beats = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<variant>")), _beat), lambda b: F.coalesce(b["text"] != "", F.lit(False)))
    beats = F.slice(beats, 1, MAX_BEATS)
    summary = F.when(kind.startswith("OBJECT"), F.nullif(_string(v, "$.scene_summary", MAX_SUMMARY), F.lit("")))
    out = rows.withColumns({"scene_summary": F.coalesce(summary, F.lit(SUMMARY)), "beats": beats})
    return out.withColumn("beats", F.when(F.size("beats") > 0, F.col("beats")).otherwise(F.array(neutral(F.col(text)))))


def aligned(rows: DataFrame, text: str = "raw_text") -> DataFrame:
    """beats whose letters and digits aren't the text's give way to one neutral beat; ``is_aligned`` says which."""
    core = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    same = core(F.array_join(F.transform("beats", lambda b: b["text"]), " ")) == core(F.col(text))
    rows = rows.withColumn("is_aligned", same)
    return rows.withColumn("beats", F.when(F.col("is_aligned"), F.col("beats")).otherwise(F.array(neutral(F.col(text)))))


def dictionaries(terms: DataFrame, key: str) -> DataFrame:
    """AG11: key and its terms in order, as array<struct<pos, term, hint>>."""
    return terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "hint"))).alias("dictionary"))


def substituted(text: Column, dictionary: Column) -> Column:
    """terms replaced one after another, in any case, where no word character adjoins them."""
    pattern = lambda t: F.concat(F.lit(r"(?i)(?<!\w)\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    plain = lambda h: F.regexp_replace(h, r"([\\$])", r"\\$1")
    return F.aggregate(F.coalesce(dictionary, F.array().cast("array<struct<pos:int,term:string,hint:string>>")), text, lambda t, d: F.regexp_replace(t, pattern(d["term"]), plain(d["hint"])))


class _Dictionary:
    """A dictionary's terms as one automaton that says which of them stand in a text; only those are replaced, in their order."""

    def __init__(self, terms: list[tuple[str | None, str | None]]):
        self.broken = any(t is None or h is None for t, h in terms)
        self.hints = [h for _, h in terms]
        self.patterns = [t if t is None else re.compile(r"(?<!\w)" + re.escape(t) + r"(?!\w)", re.IGNORECASE | re.ASCII) for t, _ in terms]
        self.always = [i for i, (t, _) in enumerate(terms) if t == ""]
        places: dict[str, list[int]] = {}
        for i, (t, _) in enumerate(terms):
            if t:
                places.setdefault(t.translate(_LOWER), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for term, at in places.items():
            self.automaton.add_word(term, at)
        if places:
            self.automaton.make_automaton()

    def _standing(self, text: str) -> list[int]:
        found = set(self.always)
        if len(self.automaton):
            for _, at in self.automaton.iter(text.translate(_LOWER)):
                found.update(at)
        return sorted(found)

    def apply(self, text: str | None) -> str | None:
        if text is None or self.broken:
            return None
        done, waiting = -1, self._standing(text)
        while waiting:
            done = waiting.pop(0)
            new = self.patterns[done].sub(lambda m: self.hints[done], text)
            if new != text:  # a replacement may bring terms that come later
                text, waiting = new, [i for i in self._standing(new) if i > done]
        return text


def substitute(texts: DataFrame, terms: DataFrame, key: str, text: str = "text", deals: int = 16) -> DataFrame:
    """F19 over tables, for dictionaries of many terms: ``texts`` with ``text`` replaced by the terms (key, pos, term, hint) of its ``key``, as ``substituted`` does it.

    A text costs one pass of its dictionary's automaton and one for each term that stands in it, whatever the number of terms. A key's texts
    are dealt to ``deals`` groups, each with a copy of the dictionary, which a task holds while the group's texts pass. Texts without a
    key or dictionary stay as they are; a dictionary with a null term or hint makes its texts null.
    """
    rows = texts.withColumn("_deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(deals)))
    held = dictionaries(terms.where(F.col(key).isNotNull()), key).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    both = rows.withColumn("_asks", F.lit(1)).unionByName(held.withColumn("_asks", F.lit(0)), allowMissingColumns=True)

    names = texts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, None
        for pdf in batches:
            out = []
            for k, deal, asks, value, listed in zip(pdf[key], pdf["_deal"], pdf["_asks"], pdf[text], pdf["dictionary"]):
                if not asks:
                    at, known = (k, deal), _Dictionary([(t["term"], t["hint"]) for t in listed])
                out.append(known.apply(value) if asks and at == (k, deal) else value)
            yield pdf.assign(**{text: out}).loc[pdf["_asks"] == 1, names]

    # by an expression that no join is dealt by, so that a dictionary and its texts stay together
    return both.repartition(F.xxhash64(F.col(key), "_deal")).sortWithinPartitions(key, "_deal", "_asks").mapInPandas(run, texts.schema)


def voice_contexts(books: DataFrame, cast: DataFrame, terms: DataFrame) -> DataFrame:
    """JN9: book_id with its narrator (by name, else the first of the cast, else defaults) and dictionary."""
    rank = F.struct(F.when(F.lower("name") == "narrator", 0).otherwise(1).alias("r"), F.col("pos"))
    narrator = cast.groupBy("book_id").agg(F.min_by(F.struct("name", "voice"), rank).alias("narrator"))
    out = books.join(narrator, "book_id", "left").join(dictionaries(terms, "book_id"), "book_id", "left")
    name, voice = F.coalesce(F.col("narrator.name"), F.lit("Narrator")), F.coalesce(F.col("narrator.voice"), F.lit("default"))
    return out.select("book_id", name.alias("narrator"), voice.alias("voice"), F.coalesce(F.size("dictionary"), F.lit(0)).alias("n_terms"))
