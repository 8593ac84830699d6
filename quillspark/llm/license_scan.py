"""License scans as an exact set-similarity join, in DataFrame functions only.

A text block is a run of words, and a template a short license notice, both as
sets of words. A template of m words is looked for in all runs of 2 m words of a
text, so that lines may be wrapped anywhere in a notice, and words scattered over
a long line don't meet. Only templates under ``SHORT`` words stay inside single
lines: their words stand by chance in neighbouring ones. Runs are first taken
together in windows of four times the longest template's words, which overlap by
half. A block meets a template if it contains at least ``threshold`` of the
template's words. Template words are ordered by how many texts have them, rarest
first. A block that meets a template of n words, needing a of them, must have one
of its first n - a + 1 words (prefix filter), at least a template words at all
(length filter), and enough of them from the first common word on, counted on
both sides (positional filter). Windows are joined with the templates' prefix
words by equality; what is left is verified by intersection, at last in each run
of the window. No pair is missed.

The templates are a parameter: their index is broadcast up to ``BROADCAST`` words,
and joined otherwise; the counts of their words are the only rows that the driver
sees.

Beside that, phrases that stand word by word are counted in whole texts: those
give the base labels.

Rows: a null or empty text has no words and no labels. Rows with equal ids get
the union of the labels that their blocks meet; null ids count as equal.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Phrases and their labels. Fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "all rights reserved"),
]
#: Templates of fewer words don't go over line ends.
SHORT = 5
#: An index of templates of more words than this isn't broadcast.
BROADCAST = 100_000
#: What stands between words: ASCII but for digits and letters, after A-Z became a-z.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but not into ASCII: the Kelvin sign, which would, gives way to another letter."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), GAP), lambda w: w != "")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base (array of labels); no shuffle.

    Words are written with a space on either side, so that places never share a character; only of texts that hold all
    words of a phrase.
    """
    likely = functools.reduce(Column.__or__, [functools.reduce(Column.__and__, [F.array_contains("words", w) for w in phrase.split()]) for phrase in phrases])
    df = docs.select(F.col(key), words_of(F.col(text)).alias("words"))
    df = df.select(key, F.size("words").cast("long").alias("n_words"), F.when(likely, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise("").alias("w"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        pattern = "".join(f" {w} " for w in phrase.split())
        there = F.contains("w", F.lit(pattern))
        counts.append(F.when(there, ((F.length("w") - F.length(F.replace("w", F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")).otherwise(0))
        firsts.append(F.when(there, (_spaces(F.substring_index("w", pattern, 1)) / 2).cast("long")))
        lasts.append(F.when(there, F.col("n_words") - (_spaces(F.substring_index("w", pattern, -1)) / 2).cast("long") - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return df.select(
        key,
        "n_words",
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.array_min(F.array(*firsts)).alias("first_word"),
        F.array_max(F.array(*lasts)).alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*labels))).alias("base"),
    )


def blocks(docs: DataFrame, vocabulary: list[str], prefix: list[str], longest: int, key: str, text: str) -> DataFrame:
    """(key, block number, its distinct words among ``vocabulary``, all its words) of every window with a word of ``prefix``; a run of 2 ``longest`` words is whole in one."""
    words = docs.select(F.col(key), words_of(F.col(text)).alias("all")).where(F.arrays_overlap("all", F.lit(prefix)))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - 2 * longest, F.lit(1)), F.lit(2 * longest))
    window = F.transform(starts, lambda at: F.slice("all", at, 4 * longest))
    return words.select(key, F.posexplode(window).alias("block", "run")).where(F.arrays_overlap("run", F.lit(prefix))).select(key, "block", F.array_intersect("run", F.lit(vocabulary)).alias("words"), "run")


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(key, block, label, containment) of every block that meets a template."""
    longest = max(len(words.split()) for _, words in templates)
    short = [(label, words) for label, words in templates if len(set(words.split())) < SHORT]
    long = [t for t in templates if t not in short]
    parts = [_meet(docs, long, longest, key, text, threshold)] if long else []
    if short:
        low = lowered(F.col(text))
        least = [(set(w.split()), math.ceil(threshold * len(set(w.split())) - 1e-9)) for _, w in short]
        likely = [sum((F.contains(low, F.lit(w)).cast("int") for w in sorted(words)), F.lit(0)) >= needed for words, needed in least]
        lines = docs.select(key, text).where(functools.reduce(Column.__or__, likely)).select(key, F.explode(F.split(text, "\n")).alias(text))
        parts.append(_meet(lines, short, longest, key, text, threshold))
    return functools.reduce(DataFrame.unionByName, parts)


def _meet(docs: DataFrame, templates: list[tuple[str, str]], longest: int, key: str, text: str, threshold: float) -> DataFrame:
    """(key, block, label, containment) of every window of the texts that meets a template."""
    sets = [(label, sorted(set(words.split()))) for label, words in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), F.lit(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # template words
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index, prefix = [], set()
    for template, (label, words) in enumerate(sets):
        needed = math.ceil(threshold * len(words) - 1e-9)
        ordered = sorted(words, key=place.__getitem__)
        for at, w in enumerate(ordered[: len(words) - needed + 1]):
            prefix.add(w)
            index.append((w, template, label, at, needed, ordered, 2 * len(templates[template][1].split())))
    right = docs.sparkSession.createDataFrame(index, "token string, template int, label string, at int, needed int, tokens array<string>, room int")
    rank = F.create_map(*[F.lit(x) for w in order for x in (w, place[w])])
    left = blocks(docs, vocabulary, sorted(prefix), longest, key, text).where(F.size("words") >= min(i[4] for i in index))
    left = left.withColumn("words", F.transform(F.array_sort(F.transform("words", lambda w: F.struct(rank[w].alias("r"), w.alias("w")))), lambda s: s["w"]))
    left = left.select(key, "block", "words", "run", F.posexplode("words").alias("mine", "token")).where(F.col("token").isin(sorted(prefix)))
    pairs = left.join(F.broadcast(right) if len(index) <= BROADCAST else right, "token").where(F.size("words") >= F.col("needed"))
    first = F.array_position("words", F.element_at(F.array_intersect("words", "tokens"), 1)) - 1 == F.col("mine")
    room = F.least(F.size("tokens") - F.col("at"), F.size("words") - F.col("mine")) >= F.col("needed")
    overlap = F.size(F.array_intersect("words", "tokens"))
    runs = F.sequence(F.lit(1), F.greatest(F.size("run") - F.col("room") + 1, F.lit(1)))
    best = F.array_max(F.transform(runs, lambda at: F.size(F.array_intersect(F.slice("run", at, F.col("room")), "tokens"))))
    met = pairs.where(room & first & (overlap >= F.col("needed"))).select(key, "block", "label", "needed", "tokens", best.alias("best"))
    return met.where(F.col("best") >= F.col("needed")).select(key, "block", "label", (F.col("best") / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment of a block that meets a template, else 0)."""
    found = matches(docs, threshold=threshold, templates=templates).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = phrase_places(docs).join(found, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
