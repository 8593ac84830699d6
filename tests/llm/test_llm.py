"""The corpus operators against brute force, round trips and held-out accuracy, on literal and small rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, components, flac_media, kk_packing, language_id, license_scan, near_copies, phrase_automata, simhash_vptree, suffix_radix, vptree_ann, windows

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, a clashing extra column."""
    long = "the road was long and nothing moved " * 4000
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, long, "en", "s", 5), (4, long, "fr", "s", 5), (5, "a b", "en", "s", 3), (5, "a b", "en", "s", 3), (None, "some words here", None, "s", 1), (7, "!!! 123", "en", None, 7), (8, "é日本 'twas don't", "fr", "s", 2)]
    return spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")).withColumn("shard", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def jobs():
    return [
        language_id.identify, byte_bpe.round_trip, simhash_vptree.near_duplicates, kk_packing.pack_documents, license_scan.scan, phrase_automata.dedup_digest, suffix_radix.dedup_digest, near_copies.near_copies, near_copies.one_of_each_group,
        flac_media.round_trip, lambda d: flac_media.read_back(flac_media.encode_texts(d)),
    ]


def test_odd_rows_do_not_crash(odd, empty):
    for job in jobs():
        n = job(odd).count()
        assert n >= 9 or job is near_copies.one_of_each_group
        assert job(empty).count() == 0


def test_odd_rows_have_defined_results(odd):
    lang = language_id.identify(odd).where("doc_id IN (1, 2, 7)").collect()
    assert {(r.lang_pred, r.score) for r in lang} == {("und", 0.0)}
    near = {r.doc_id: r for r in simhash_vptree.near_duplicates(odd).where("doc_id IS NOT NULL").collect()}
    assert near[1].fp == near[2].fp == 0 and near[2].component_id == 1 and near[4].component_id == 3


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) > 0


def test_language_vectors_equal_brute_force(spark):
    """Bundles of bound letters, prototypes and cosines, recomputed letter by letter."""
    rng = random.Random(14)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word("abcé" if i % 2 else "cdeß") for _ in range(12)) + (", X1!" if i % 3 else ""), "ab"[i % 2]) for i in range(40)] + [(40, "12 !", "a"), (41, None, "b"), (42, "x", None)]
    vector = {c: language_id.letter_vectors(np.array([ord(c)], np.uint32))[0].astype(int) for c in "abcdeéßx \0"}

    def document(text):
        letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        total = np.zeros(language_id.DIMS)
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if b != " ":
                total += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
        return total

    unit = lambda v: v / (np.linalg.norm(v) or 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.where(language_id.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    prototypes = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and i not in held:
            prototypes[lang] = prototypes.get(lang, 0) + unit(document(t))
    for r in language_id.identify(docs).collect():
        text = rows[r.doc_id][1] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {lang: float(unit(document(text)) @ unit(p)) for lang, p in sorted(prototypes.items())}
        best = max(cosine, key=cosine.get)
        assert r.lang_pred == best and abs(r.score - max(cosine[best], 0)) < 1e-4


def test_byte_bpe_equals_the_library():
    import tiktoken

    c = byte_bpe.codec()
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice(["'", "s", "re", "ll", " ", "  ", "\n", " ", "é", "1", "!", "日", "😀", "<|endoftext|>"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["ab" * 3000, " " * 900 + "x"]
    for t, ids in zip(texts, c.encode_batch(texts)):
        assert ids.tolist() == ref.encode_ordinary(t)
        assert c.decode(ids) == t.encode() and c.offsets(ids)[-1] == len(t.encode())


def test_byte_bpe_columns(spark):
    df = spark.createDataFrame([(1, "Don't stop"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(df)).collect()}
    assert bytes(got[1].decoded) == b"Don't stop" and got[1].offsets[-1] == 10 and got[2].ids == []


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(300):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice("abcdefghij")
        rows.append((i, " ".join(w)))
    got = simhash_vptree.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    fp = [r.fp for r in got]
    label = list(range(300))
    while True:
        new = [min(label[j] for j in range(300) if bin((fp[i] ^ fp[j]) & (1 << 64) - 1).count("1") <= 3) for i in range(300)]
        if new == label:
            break
        label = new
    assert [r.component_id for r in got] == label


def test_links_go_through_rows_without_an_id(spark):
    """Two documents that only a row with a null id links are of one class, in both operators."""
    rng = random.Random(21)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    ends = [" ".join(w[:187]), " ".join(w[13:])]  # 0.87 to the middle each, 0.76 to each other
    docs = spark.createDataFrame([(5, ends[0]), (None, " ".join(w)), (8, ends[1]), (None, "quite alone")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert (got[5], got[8]) == (5, 5)
    print_of = simhash_vptree.fingerprint(" ".join(w), 3)
    apart = lambda a, b: bin(a ^ b).count("1")
    found = None
    for i in range(4000):  # texts whose fingerprints lie on either side of the middle one's
        t = " ".join(w[:i % 200] + [f"x{i}"] + w[i % 200 + 1 :])
        near = simhash_vptree.fingerprint(t, 3)
        if 2 <= apart(near, print_of) <= 3:
            if found and apart(found[1], near) > 3:
                break
            found = found or (t, near)
    docs = spark.createDataFrame([(5, found[0]), (None, " ".join(w)), (8, t)], "doc_id long, text string")
    assert {r.component_id for r in simhash_vptree.near_duplicates(docs).collect()} == {5}


def test_large_leaves_are_split(spark):
    """Few leaves and a small sample: leaves are split by further vantage points, a swarm that none separates by blocks."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(base[i % 40] ^ np.uint64(1) << np.uint64(rng.integers(63))) for i in range(600)} | {int(base[0]) ^ 1 << i ^ 1 << j for i in range(25) for j in range(i)}
    nodes = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in nodes.view(np.int64)], "node long")
    got = simhash_vptree.Forest(len(nodes))
    links = simhash_vptree.links(frame, 3, sample_rows=100, leaf_rows=64).toPandas()
    place = {int(x): i for i, x in enumerate(nodes.view(np.int64))}
    got.link(links.a.map(place).to_numpy(), links.b.map(place).to_numpy())
    want = simhash_vptree.Forest(len(nodes))
    want.link(*np.nonzero(np.bitwise_count(nodes[:, None] ^ nodes[None]) <= 3))
    assert np.array_equal(got.roots(np.arange(len(nodes))), want.roots(np.arange(len(nodes))))


def similar_rows():
    """Families of texts with more and more words changed, copies included."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(400)] for _ in range(6)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 4, 12, 60])):
            w[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows


def shingle_sets(rows):
    return [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for _, t in rows)]


def test_near_copies_lose_no_similar_pair(spark):
    rows = similar_rows()
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = shingle_sets(rows)
    close = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    for i in range(160):
        assert got[i] == i or any(got[j] == got[i] and close(i, j) > 0.65 for j in range(160) if j != i)
        for j in range(i):
            assert close(i, j) < 0.8 or got[i] == got[j]
    assert len(set(got.values())) > 6


def test_near_copies_do_not_depend_on_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(similar_rows(), "doc_id long, text string")
    want = near_copies.near_copies(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(near_copies, "SHARD", 8)
    assert near_copies.near_copies(docs).orderBy("doc_id").collect() == want


def brute_force_classes(rows):
    """The smallest id that links of pairs at 0.8 or more reach."""
    sets, label = shingle_sets(rows), [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and label[i] != label[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(zip((i for i, _ in rows), label))


@pytest.mark.parametrize("held", [near_copies.HELD, 2000])
def test_near_copies_link_nothing_less_similar(spark, monkeypatch, held):
    monkeypatch.setattr(near_copies, "HELD", held)
    rng, rows = random.Random(11), similar_rows()
    for i in range(160, 200):  # pairs at about 0.75: 50 shingles of 400 lost, as many new
        w = rows[i - 1][1].split() if i % 2 else [f"y{rng.randrange(10**6)}" for _ in range(400)]
        for k in range(0, 55 * (i % 2), 5):
            w[k * 7] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force_classes(rows)


def test_near_copies_lose_no_short_pair(spark):
    """Short texts and the same with one word more: the sieve alone lost about half of the pairs of 8 and 9 words."""
    rng, rows = random.Random(12), []
    for n in [8] * 12 + [9] * 6 + [16] * 6 + [30] * 6 + [7] * 6:
        w = [f"v{rng.randrange(10**6)}" for _ in range(n + 1)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:-1]))]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force_classes(rows)


def test_near_copies_shards_equal_all_comparisons():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (3, near_copies.WORDS), dtype=np.uint64)
    rows = []
    for _ in range(90):
        bits = np.unpackbits(base[rng.integers(3)].view(np.uint8))
        bits[rng.integers(0, near_copies.BITS, rng.choice([20, 90, 130, 300]))] ^= 1
        rows.append(np.packbits(bits).view(np.uint64))
    wide = np.array(rows)
    frame = pd.DataFrame({"shard": 1, "i": 0, "j": 0, "node": range(90), "wide": [w.tobytes() for w in wide]})
    whole, pairs = simhash_vptree.Forest(90), np.bitwise_count(wide[:, None] ^ wide[None]).sum(axis=2) <= 180
    whole.link(*np.nonzero(pairs))
    got = simhash_vptree.Forest(90)
    links = near_copies._link_shards(frame, 180)
    got.link(links.a.to_numpy(), links.b.to_numpy())
    assert np.array_equal(got.roots(np.arange(90)), whole.roots(np.arange(90)))
    assert len(links) < 90


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "A b C d e  f"), (2, "g h i j k l"), (None, "g h i j k l"), (5, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    kept = near_copies.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None, 4}


def test_stored_tables_go(spark):
    """Steps of components are deleted; a stored table stays readable until it is."""
    from pathlib import Path

    from quillspark.llm import scratch

    folder = Path(scratch.shared_dir(spark).removeprefix("file:").replace("//", "/"))
    before = set(folder.iterdir())
    components.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")).count()
    assert len(set(folder.iterdir()) - before) == 1  # the result
    df, path = scratch.stored_at(spark.range(3))
    assert df.count() == 3
    scratch.delete(spark, path)
    assert len(set(folder.iterdir()) - before) == 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100}


def test_packing_pieces_fit_and_cover(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = kk_packing.pack_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    held = rows.groupby("sequence_id").length.sum()
    assert held.max() <= 4096 and held.sum() >= 0.9 * 4096 * len(held)
    for _, g in rows.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    for _, g in rows.sort_values(["doc_id", "start"]).groupby("doc_id"):
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]


def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_encoder_equals_the_tokenizer():
    e, t, rng = kk_packing.encoder(), fresh_tokenizer(), random.Random(4)
    pieces = ["'", "s", "re", " ", "\n", "É", "́", "1", "!", ".", ",", "日", "İ", "Σ", "ß", "ab", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["hi <|endoftext|> there", "a<|startoftext|>b <|endoftext|>", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000))]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_equals_a_fresh_tokenizer(spark):
    """Every piece's crc and place, recomputed; with a null id, repeated rows, marks and a text of several windows."""
    texts = ["one <|endoftext|> two", None, "", "word " * 9000, "same", "same", "Ünïcode, it's here."]
    rows = [(None if x == "same" else i, x) for i, x in enumerate(texts)]
    got = kk_packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    t, want = fresh_tokenizer(), Counter()
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((i, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)) for start, n in kk_packing.cuts(len(ids)))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096


def test_equal_rows_make_no_large_group(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("some equal words").alias("text"))
    got = kk_packing.pack_documents(rows, group_pieces=500)
    sizes = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 700


def test_differencing_balances():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1024, 500)
    w = kk_packing.differencing(sizes, 70)
    load = np.bincount(w, sizes, minlength=70)
    assert load.sum() == sizes.sum() and load.max() - load.min() < 60


def test_nearest_is_exact_at_factor_one_and_close_above(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(400, 8)), np.repeat(rng.normal(size=(1, 8)), 60, axis=0)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {}
    for q in range(0, 460, 20):
        s = sorted((-float(vptree_ann.paired(x[q : q + 1], x[j : j + 1])[0]), j) for j in range(460) if j != q)[:20]
        want[q] = [(j, -v) for v, j in s]
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        got: dict = {}
        for r in vptree_ann.nearest(df, df.where("vec_id % 20 = 0"), factor=factor, shard_rows=128).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        hits = sum(len(set(got[q]) & set(want[q])) for q in want)
        assert set(got) == set(want) and hits >= least * 20 * len(want)
        assert factor > 1 or got == want


def test_nearest_with_crowded_vectors_and_odd_rows(spark):
    """A third of all rows at one place, repeated ids, clashing columns, few rows, none."""
    rng = np.random.default_rng(16)
    x = np.concatenate((rng.normal(size=(200, 5)), np.repeat([[0.5, 0.0, 0, 0, 1]], 400, axis=0), np.repeat([[3.0, 0, 0, 0, 0]], 3, axis=0)))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(7, x[3].tolist()), (None, x[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'clash' AS leaf", "'clash' AS score")
    ids, all_ = np.array([i for i, _ in rows[:-1]]), np.array([v for _, v in rows[:-1]])
    got: dict = {}
    for r in vptree_ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 603, 50):
        s = vptree_ann.paired(np.repeat(x[q : q + 1], len(all_), axis=0), all_)
        want = sorted((-float(v), int(i)) for v, i in zip(s, ids) if i != q)[:20]
        assert got[q] == [(i, -v) for v, i in want]
    few = df.where("vec_id < 5")
    assert vptree_ann.nearest(few, few).count() == 20 and vptree_ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_license_phrases_and_templates(spark):
    rows = [(1, "x Under the MIT license, under the mit license"), (2, "All rights\nreserved"), (3, "ALL rights reserved."), (4, None), (5, "Licensed: Apache License, Version 2.0 the under")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 5, "mit")
    assert got[2].labels == "" and got[3].labels == "all-rights-reserved" and got[3].score == 1.0
    assert (got[4].n_words, got[4].first_word, got[4].labels) == (0, None, "")
    assert got[5].base_labels == "apache-2" and got[5].score == 1.0


def test_license_notices_over_line_ends(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    apache = " * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at"
    bsd = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions are met"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License"
    filler = "some other words stand here\n"
    rows = [(4 * n + i, filler * n + "w " * (5 * n) + t + "\n" + filler * n) for n in range(12) for i, t in enumerate((mit, apache, bsd, gpl))]
    scattered = ["nothing"] * 4000
    for at, w in enumerate("released under the mit license all rights reserved".split()):
        scattered[at * 450] = w
    rows += [(100, " ".join(scattered)), (101, "All rights are\nwith us; reserved"), (102, "mit einer neuen und ganz anderen\nBezeichnung ist es:\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(48)] == [(x, 1.0) for x in ("mit", "apache-2", "bsd", "gpl-3")] * 12
    assert got[100] == got[101] == ("", 0.0) and got[102] == ("apache-2", 1.0)


def without_repeated_words(rows, length, order=lambda i: (i is None, i)):
    """By brute force: how often (id, words, words removed, digest of the rest) is the answer."""
    seen, want = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (order(r[0]), r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            if x in seen:
                gone[k : k + length] = [True] * length
            seen.add(x)
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    return want


def without_repeated_bytes(rows, length):
    """The same for bytes: (id, bytes, bytes removed, spans, digest of the rest)."""
    count = Counter(b[k : k + length] for b in ((t or "").encode() for _, t in rows) for k in range(len(b) - length + 1))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return want


def repeating_rows(seed, alphabet, heavy):
    """Texts that share passages, copies (many of one text, if heavy), a text that repeats itself, null and empty ones."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    base = [make(rng.randint(0, 300)) for _ in range(8)]
    rows = [(i, rng.choice(base) + " " * rng.randint(0, 2) + (make(9) if rng.random() < 0.5 else rng.choice(base))) for i in range(40)]
    rows += [(50, alphabet[0] * 120), (51, None), (52, "x " * 60), (53, ""), (None, base[0] + "q"), (54, "\0" * 60)]
    if heavy:
        rows += [(60 + i // 2, base[1] + base[2]) for i in range(30)] + [(None, base[1] + base[2])] * 2 + [(90 + i, alphabet[0] + " few") for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy,spread", [(False, windows.SPREAD), (True, windows.SPREAD), (False, 0), (True, 3)])
def test_repeated_phrases(spark, monkeypatch, heavy, spread):
    """Without hot minimisers, with all hot, and with some."""
    monkeypatch.setattr(windows, "HEAVY", 60 if heavy else windows.HEAVY)
    monkeypatch.setattr(windows, "SPREAD", spread)
    rows = repeating_rows(7, ["a ", "b ", "cc ", "é ", "\n", "d"], heavy)
    got = phrase_automata.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == without_repeated_words(rows, 8)


def test_repeated_phrases_with_ids_of_letters(spark):
    rows = [(None if i is None else f"k{i * 7 % 100:02d}", t) for i, t in repeating_rows(9, ["a ", "b ", "cc "], False)]
    got = phrase_automata.dedup_digest(spark.createDataFrame(rows, "name string, text string"), 8, key="name")
    assert Counter((r.name, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == without_repeated_words(rows, 8)


def test_different_words_of_equal_sums_stay(spark):
    """A Thue-Morse word and its complement have the same polynomial digest modulo 2^64 to any odd base."""
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    same = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{same} {bits}"), (2, f"{same} {bits.translate(str.maketrans('ab', 'ba'))}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in phrase_automata.dedup_digest(docs).collect()} == {0}
    short = spark.createDataFrame([(1, bits), (2, bits.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(short).collect()} == {1: 1, 2: 2}


def test_word_digests_of_texts_together_and_in_pieces():
    texts = [b"a b  c", b"", b" \n ", b"word " * 5000 + b"end", b"c b a", b"x" * 300]
    found = phrase_automata.digests_of(texts, 100)
    assert [len(d) for d in found] == [len(t.split()) for t in texts]
    one = {w: d for t, digests in zip(texts, found) for w, d in zip(t.split(), digests.tolist())}
    assert all(one[w] == d for t, digests in zip(texts, phrase_automata.digests_of(texts)) for w, d in zip(t.split(), digests.tolist()))
    assert len(set(one.values())) == len(one)


def test_automaton_finds_all_occurrences():
    table = pa.table({"shard": [0, 0], "id": [1, 2], "text": ["a b c d a b c", "z a b c d"], "copies": [1, 1]})
    words = phrase_automata.Words(table, 3)
    assert words.occurrences({b"a b c", b"b c d"}).tolist() == [0, 1, 4, 8, 9]
    assert words.occurrences({b"a b c d"}).tolist() == [0, 1, 8, 9] and words.occurrences(set()).tolist() == []


@pytest.mark.parametrize("operator,line", [(suffix_radix, "a line of one hundred and fifty bytes that stands in each of the documents, as footers do: " + "x" * 60), (phrase_automata, " ".join(f"line{i}" for i in range(14)))])
def test_a_line_of_all_documents_makes_no_large_bucket(operator, line):
    """Its contexts differ, so none is left to compare: they wait in rows of their shards, and none of their windows recurs."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(30))
    made = suffix_radix.Texts if operator is suffix_radix else phrase_automata.Words
    shards = [made(pa.table({"shard": [k] * 100, "id": list(range(100 * k, 100 * k + 100)), "text": [f"{text()} {line} {text()}" for _ in range(100)], "copies": [1] * 100}), operator.LENGTH) for k in range(4)]
    crowd = windows.all_of([b for s in shards for b in s.minimisers(16)["crowd"].to_pylist()])
    sent = [row for s in shards for row in operator.send(s, crowd, crowd, 16).to_pylist()]
    assert len(crowd) and {r["bucket"] for r in sent} == {windows.SIEVED - k for k in range(4)}
    digests = [operator._digests(row, operator.LENGTH)[0] for row in sent]
    values, counts = np.unique(np.concatenate(digests), return_counts=True)
    kept = values[counts > 1]
    assert min(map(len, digests)) > 500 and sum(len(operator._part(row, kept, operator.LENGTH, 16)) for row in sent) == 0


def test_short_templated_texts_meet_by_their_rarest_shingles():
    """Sets that share half of their shingles, a few of them at 0.8: the links' components are those of all pairs."""
    rng = np.random.default_rng(3)
    sets = [np.sort(np.concatenate((np.arange(5), rng.choice(np.arange(10, 60), 5, replace=False)))).astype(np.uint64) for _ in range(400)]
    sets += [np.unique(np.append(s[:-1], np.uint64(70 + i % 3))) for i, s in enumerate(sets[:60])] + [np.zeros(0, np.uint64)] * 2
    frame = pd.DataFrame({"node": np.arange(len(sets)), "shard": 0, "i": 0, "j": 0, "shingles": [s.tobytes() for s in sets]})
    for similarity in (0.8, 0.6):
        links = near_copies._link_sets(frame, similarity)
        forest, want = simhash_vptree.Forest(len(sets)), simhash_vptree.Forest(len(sets))
        forest.link(links["a"].to_numpy(), links["b"].to_numpy())
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and len(c := np.intersect1d(sets[i], sets[j])) / (len(sets[i]) + len(sets[j]) - len(c)) >= similarity]
        want.link(*np.array(pairs).T)
        every = np.arange(len(sets))
        assert len(pairs) > 30 and (forest.roots(every) == want.roots(every)).all()


@pytest.mark.parametrize("heavy,spread", [(False, windows.SPREAD), (True, windows.SPREAD), (False, 0), (True, 3)])
def test_repeated_bytes(spark, monkeypatch, heavy, spread):
    """Without hot minimisers, with all hot, and with some."""
    monkeypatch.setattr(windows, "HEAVY", 60 if heavy else windows.HEAVY)
    monkeypatch.setattr(windows, "SPREAD", spread)
    rows = repeating_rows(8, "abé ", heavy)
    got = suffix_radix.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string"), 24)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == without_repeated_bytes(rows, 24)


def test_windows_of_texts_in_pieces():
    """A document cut into runs has the same minimisers and the same windows in its contexts."""
    rng = np.random.default_rng(4)
    data = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (3000, 10, 700, 24, 0, 23)]
    make = lambda run: windows.Shard(data, lambda some: windows.byte_grams(b"".join(some)), 8, 24, run)
    whole, cut = make(1 << 16), make(100)
    every = np.unique(whole.values())
    assert np.array_equal(np.sort(whole.values()), np.sort(cut.values()))
    windows_of = lambda shard: sorted((a + t, o - t, s) for a, c, o, s in zip(*(x.tolist() for x in shard.contexts(every))) for t in range(c))
    assert windows_of(whole) == windows_of(cut) and len(windows_of(cut)) == 2977 + 677 + 1


def test_classes_equal_brute_force(monkeypatch):
    """Windows around seeds, compared by radix orders, in small chunks and in one."""
    rng, length = random.Random(6), 24
    contexts = []
    for _ in range(400):
        o, k = rng.randint(0, 15), 1
        k = rng.randint(1, o + 1)
        seed = rng.choice([b"abcdefgh", b"hgfedcba"])
        body = bytearray(rng.choice(b"xy") if rng.random() < 0.1 else 120 for _ in range(k + length - 1))
        body[o : o + 8] = seed
        contexts.append((seed == b"hgfedcba", o, k, 1 + (rng.random() < 0.05), bytes(body)))
    seen = Counter()
    for s, o, k, w, b in contexts:
        for t in range(k):
            seen[s, o - t, b[t : t + length]] += w
    want = [seen[s, o - t, b[t : t + length]] > 1 for s, o, k, _, b in contexts for t in range(k)]
    columns = [np.array(x, np.int64) for x in list(zip(*contexts))[:4]]
    for size in (50, 20_000):
        monkeypatch.setattr("quillspark.llm.contexts.CHUNK", size)
        assert suffix_radix.repeated_in(columns[0].astype(np.uint64), *columns[1:], [b for *_, b in contexts], length).tolist() == want


def test_without_repeats_keeps_columns(odd):
    out = suffix_radix.without_repeats(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id, r.n_chars) for r in out.where("doc_id IS NOT NULL AND doc_id <> 2").collect()) == [(1, 0), (5, 3), (5, 3), (7, 7), (8, 2)]


def test_flac_round_trips_and_checksums():
    rng = np.random.default_rng(9)
    payloads = [flac_media.payload_of(t) for t in (None, "a" * 576, "hello " * 300, "é日" * 400)] + [rng.integers(0, 256, 1152, dtype=np.uint8).tobytes(), (np.sin(np.arange(2880) / 9) * 100 + 128).astype(np.uint8).tobytes()]
    for order in (0, 2, 4, 8):
        streams = flac_media.encode_streams(payloads, order)
        assert flac_media.decode_streams(streams) == payloads
    kinds = {frame[6] >> 1 for s in streams for b in flac_media.decode_blocks([s])[0][:1] for frame in [s[b[2] :]]}
    assert 31 + 8 in kinds and 0 in kinds  # a linear predictor of the eighth order, a constant
    for at in (-40, -1, 5, 40):
        broken = bytearray(streams[2])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            flac_media.decode_streams([bytes(broken)])
    for cut in range(0, 90, 7):
        with pytest.raises(ValueError):
            flac_media.decode_streams([streams[2][:cut]])


def test_flac_frames_may_hold_what_looks_like_a_header():
    """Plain samples that equal the next frames' headers, checksum of the header included."""
    rng, header = np.random.default_rng(10), lambda i: b"\xff\xf8\x24\x02" + bytes([i])
    noise = bytearray(rng.integers(0, 256, 576 * 4, dtype=np.uint8).tobytes())
    for i in range(1, 4):
        like = header(i) + bytes([flac_media._crc8(header(i))])
        noise[576 * (i - 1) + 100 : 576 * (i - 1) + 106] = bytes(b ^ 0x80 for b in like)
    stream = flac_media.encode_streams([bytes(noise)])[0]
    assert stream.count(header(1)) == 2 and flac_media.decode_streams([stream, stream]) == [bytes(noise)] * 2


def test_flac_reads_other_frame_sizes():
    """A stream written here by hand: frames of 192, 300 (told in one byte more) and 1000 (in two), numbered by samples."""
    samples = np.random.default_rng(11).integers(0, 256, 1492, dtype=np.uint8).tobytes()
    body, at = b"", 0
    for size, code, tail in ((192, 1, b""), (300, 7, (299).to_bytes(2, "big")), (1000, 7, (999).to_bytes(2, "big"))):
        head = bytes([0xFF, 0xF9, code << 4 | 4, 0x02]) + flac_media._coded_number(at) + tail
        frame = head + bytes([flac_media._crc8(head)]) + b"\x02" + bytes(b ^ 0x80 for b in samples[at : at + size])
        body += frame + int(flac_media._crc([frame], 16)[0]).to_bytes(2, "big")
        at += size
    signed = bytes(b ^ 0x80 for b in samples)
    info = (192).to_bytes(2, "big") + (1000).to_bytes(2, "big") + bytes(6) + (8000 << 44 | 7 << 36 | 1492).to_bytes(8, "big") + hashlib.md5(signed).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body
    blocks = flac_media.decode_blocks([stream])[0]
    assert [b[:2] for b in blocks] == [(0, 192), (192, 300), (492, 1000)] and b"".join(b[3] for b in blocks) == samples


def test_flac_columns(spark):
    """Every column of the query, recomputed from the texts; equal texts, equal values."""
    texts = [None, "", "a" * 576, "a" * 577, "héllo wörld " * 300, "héllo wörld " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = flac_media.round_trip(docs).orderBy("doc_id").collect()
    stored = {r.doc_id: bytes(r.media) for r in flac_media.encode_texts(docs).collect()}
    for r, t in zip(rows, texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        assert r.feature.startswith(f"n={len(x)};peak={abs(x).max()};sum={x.sum()};energy={(x * x).sum()};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()};blocks={len(x) // 576};")
    assert rows[4][1:] == rows[5][1:] and rows[0][1:] == rows[1][1:]
    assert flac_media.read_back(flac_media.encode_texts(docs)).orderBy("doc_id").collect() == rows


def test_flac_blocks_can_be_sought(spark):
    df = spark.createDataFrame([(1, "lorem ipsum " * 200)], "doc_id long, text string")
    blocks = flac_media.pcm_blocks(flac_media.encode_texts(df)).orderBy("frame").collect()
    assert [b.first_sample for b in blocks] == [576 * i for i in range(len(blocks))]
    assert b"".join(bytes(b.pcm) for b in blocks) == flac_media.payload_of("lorem ipsum " * 200)


def test_pipeline_stages_equal_brute_force(spark, monkeypatch):
    """The stages between language ID and packing, each against brute force on what the one before kept."""
    import corpus_pipeline

    rng = random.Random(19)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    for i in range(12):  # near copies, copies, and texts that share a passage
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((10_000 + i, " ".join(w) if i % 2 else rows[i][1], "en", "s", 1))
        rows.append((20_000 + i, f"A text of its own number {i}. " + rows[3][1][:300] + " and so it ends.", "en", "s", 1))
    rows += [(30_000, "12 34", "en", "s", 5), (30_001, None, "en", "s", 0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, DOC)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, frame, SF).collect()
    assert {30_000, 30_001}.isdisjoint(r.doc_id for r in first) and len(first) >= 70
    kept = spark.createDataFrame(first, DOC)
    second = stages["simhash_near_dedup"](spark, kept, SF).collect()
    classes = brute_force_classes([(r.doc_id, r.text) for r in first])
    short = {r.doc_id for r in first if len(r.text.split()) < 5}
    assert {r.doc_id for r in second} - short == {i for i, c in classes.items() if i == c} - short
    third = stages["suffix_array_dedup"](spark, spark.createDataFrame(second, DOC), SF).collect()
    want = without_repeated_bytes([(r.doc_id, r.text) for r in second], 200)
    left = {i: (n, gone) for i, n, gone, _, _ in want}
    assert {r.doc_id for r in third} == {i for i, (n, gone) in left.items() if n > gone}
    for r in third:
        n, gone = left[r.doc_id]
        assert n - gone - 3 <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < rows.doc_id.nunique() <= docs.count()
    assert rows.groupby("sequence_id").length.sum().max() <= 4096
