"""Spelling variants, token counts and hard negatives against brute force and the library, on literal and random rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import hard_negatives, spelling_variants, token_transducer

DOC = "doc_id long, text string, score string"


def one_edit(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in letters} | {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in letters}
    return out - {word}


def brute_variants(rows):
    counted, lower = Counter(), str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    n = {w: c for w, c in counted.items() if len(w) >= 7 and c >= 2}
    letters = sorted({c for w in n for c in w})
    near = {w: sorted((x for x in one_edit(w, letters) if x in n), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 10 * n[w] else None for w in n}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


@pytest.fixture(scope="module")
def spelt():
    rng, base = random.Random(3), ["separate", "because", "Étranger", "ÀÇÐñþÿ÷×", "mississippi", "aaaaaaaa"]
    rows = []
    for i in range(60):
        words = []
        for w in base:
            for _ in range(rng.randint(1, 40)):
                edits = rng.choice([0] * 12 + [1, 1, 2])
                for _ in range(edits):
                    k = rng.randrange(len(w))
                    w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abeéÿ") + w[k:], w[:k] + rng.choice("abeéÿ") + w[k + 1 :]]) or w
                words.append(w)
                w = rng.choice(base)
        rows.append((i, rng.choice([" ", "-", "1"]).join(words), "x"))
    # a chain of forms: each word ten times as frequent as the one before
    chain = ["chainedx", "chainedxy", "chainedxyz", "chainedxyzw"]
    rows += [(1000 + k, " ".join([w] * 2 * 11**k), "x") for k, w in enumerate(chain)]
    return rows + [(5, None, None), (6, "", "x"), (None, "Separate separatE because-because", "x"), (None, None, None), (7, "separate", "x"), (7, "separate", "x"), (8, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999 + " " + "z" * 4999, "x")]


def test_spelling_variants_equal_brute_force(spark, spelt):
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants.variants(spark.createDataFrame(spelt, DOC)).collect()}
    assert got == brute_variants(spelt)
    assert sum(v[2] is not None for v in got.values()) > 5 and got["chainedx"][4] == "chainedxyzw"


@pytest.mark.parametrize("size,most_bits", [(2, 1 << 10), (5, 1 << 28)])
def test_near_words_need_neither_filter_nor_alphabet(spark, spelt, size, most_bits):
    """A crowded filter and many words on one reduced word cost comparisons, and no result."""
    want = {w: v[1] for w, v in brute_variants(spelt).items() if v[1]}
    words = spark.createDataFrame([(w, v[0]) for w, v in brute_variants(spelt).items()], "word string, n long")
    got = Counter(r.word for r in spelling_variants.near_words(words, size, most_bits).collect())
    assert got == want


def test_neighbourhoods_hold_each_neighbour_once():
    rng = random.Random(4)
    for size in (1, 2, 3):
        for length in (1, 2, 5):
            words = ["".join(rng.choice("abc") for _ in range(length)) for _ in range(20)]
            d, _ = spelling_variants.symbols(words, size)
            d = d.reshape(len(words), length)
            digest = lambda s: sum(int(x) * pow(spelling_variants._BASE, i, 1 << 64) for i, x in enumerate(s)) % (1 << 64)
            for row in range(len(words)):
                own = tuple(d[row].tolist())
                letters = range(1, size + 1)
                want = {own} | {own[:i] + own[i + 1 :] for i in range(length)} | {own[:i] + (a,) + own[i + 1 :] for i in range(length) for a in letters} | {own[:i] + (a,) + own[i:] for i in range(length + 1) for a in letters}
                got = [int(x) for rows, made in spelling_variants.neighbourhoods(d, size) for r, x in zip(rows, made) if r == row]
                assert sorted(got) == sorted(map(digest, want))


def test_no_documents_have_no_variants(spark):
    assert spelling_variants.variants(spark.createDataFrame([], DOC)).count() == 0
    assert spelling_variants.variants(spark.createDataFrame([(1, "too few words here", "x")], DOC)).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_transducer.VOCABULARY))


def test_token_counts_equal_the_library(library):
    rng = random.Random(2)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", "l", "r", "v", " ", "  ", "\n", "é", "é", "1", "!", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "the", "ing", "tion", "a", "ß", "İ", "Σ", "½", " ", "﻿", " ", "S", "LL", "ﬁ"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 18))) for _ in range(4000)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(2000)] + ["".join(rng.choice("aeiost") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    texts += ["ab" * 4000, "x" * 3000 + " " + "y" * 2000, "", " ", "!" * 999, "'" * 500, "日" * 2000]
    assert token_transducer.count_batch(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_are_read_in_stretches(library, monkeypatch):
    monkeypatch.setattr(token_transducer, "BATCH", 50)
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abc'é1!日") for _ in range(rng.randint(1, 90))) for _ in range(400))
    assert "".join(token_transducer.stretches(text, 50)) == text
    assert token_transducer.count_batch([text, text[:7]]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in (text, text[:7])]


def test_states_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(token_transducer, "MOST_STATES", 10)
    texts = ["the forgotten states", "are compiled again", "and counted alike"] * 5
    got = [int(token_transducer.count_batch([t])[0]) for t in texts]
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_maps_compose_as_the_walk_does():
    step, _, _ = token_transducer.piece_transducer()
    kind = np.random.default_rng(6).integers(0, token_transducer.CLASSES, (40, 7))
    maps = np.tile(np.arange(token_transducer.STATES), (40, 1))
    for k in range(7):
        maps = step[maps, kind[:, k, None]].astype(np.int64)
    state = np.arange(token_transducer.STATES)
    for chunk, whole in zip(maps, token_transducer.scanned(maps)):
        state = chunk[state]
        assert (whole == state).all()


def test_token_count_columns(spark, library):
    long = "the road's long, and 12 things didn't move " * 6000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, None), (None, "a b", "x"), (5, "don't", "x"), (5, "don't", "x")]
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_transducer.token_counts(spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit("clash"))).collect()]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_transducer.token_counts(spark.createDataFrame([], DOC)).count() == 0


def brute_negatives(rows, every):
    ok = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and len(v) == 4 and not any(x is None or math.isnan(x) or math.isinf(x) for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out, asked = [], {}
    for i, label, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, (label, v)), (label, v))
    for a, (label, v) in asked.items():
        scored = sorted((-dot(v, w), i, other) for i, other, w in ok if i != a)
        for s, p, other in [x for x in scored if x[2] == label][:5]:
            fine = [(t, q) for t, q, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r, q, -s, -t) for r, (t, q) in enumerate(fine, 1)]
    return sorted(out)


VEC = "vec_id long, label int, embedding array<double>, rank string"


@pytest.mark.parametrize("shard_rows", [16_384, 9])
def test_hard_negatives_equal_brute_force(spark, shard_rows):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 2), [float(rng.randint(-9, 9)) for _ in range(4)]) for i in range(400)]
    rows += [(i, 1, [0.0] * 4) for i in (400, 405)] + [(i, 0, [5.0, 5.0, 5.0, 5.0]) for i in range(410, 440)]  # zeros; ties
    rows += [(None, 1, [1.0] * 4), (441, None, [1.0] * 4), (442, 1, None), (443, 1, [1.0, None, 1.0, 1.0]), (444, 1, [float("nan"), 1.0, 1.0, 1.0]), (445, 1, [float("inf"), 1.0, 1.0, 1.0]), (446, 1, [1.0]), (447, 1, [])]
    rows += [(410, 2, [1.0, 2.0, 3.0, 4.0]), (3, 2, [7.0, 2.0, 3.0, 4.0])]  # repeated ids
    df = spark.createDataFrame([(*r, "clash") for r in rows], VEC)
    got = hard_negatives.mine(df, F.col("vec_id") % 5 == 0, shard_rows=shard_rows)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.select(columns).collect())) == brute_negatives(rows, 5)


def test_hard_negatives_of_large_and_no_vectors(spark):
    big = [(i, i % 2, [float(1 << 29), float(i), 1.0, 0.0]) for i in range(30)]  # products beyond what a double holds
    df = spark.createDataFrame([(*r, "x") for r in big], VEC)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, low=0, high=100)
    assert got.count() > 0 and all(r.positive_score == (1 << 58) + r.anchor_id * r.positive_id + 1 for r in got.collect())
    assert hard_negatives.mine(spark.createDataFrame([], VEC), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") < 0).count() == 0


def test_walk_stops_where_the_bound_certifies():
    """Short candidates lie behind the point where every member has its places."""
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.integers(50, 60, (600, 4)), rng.integers(0, 2, (5000, 4)))).astype(np.int64)
    shard = hard_negatives.Shard(np.arange(len(x)), np.zeros(len(x), np.int64), x)
    shard.sort_for(0, None, 0.0)
    seen, scores = [], shard.scores
    shard.scores = lambda at, u: seen.append(len(at)) or scores(at, u)
    u = rng.integers(1, 9, (20, 4))
    who, slot, score, found = shard.walk(-np.arange(1, 21), np.zeros(20, np.int64), u, np.full((20, 1), np.iinfo(np.int64).max), np.full((20, 1), hard_negatives._NONE + 1), 5, True)
    assert sum(seen) <= 1024
    for m in range(20):
        want = sorted(zip(-(x @ u[m]), range(len(x))))[:5]
        assert [(-s, f) for s, f in zip(score[who == m], found[who == m])] == want
