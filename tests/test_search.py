"""Catalogue search against scoring all pairs in plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.operators.top_candidates import top_candidates

CANDIDATE = "id int, title string, subtitle string, authors array<string>, isbn string, language string, format string, filesize long"
QUERY = "query_id int, q_title string, q_author string, q_isbn string, q_languages array<string>, q_formats array<string>"


def norm(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not "̀" <= c <= "ͯ")
    return re.sub("[^a-z0-9]+", " ", t).strip()


def toks(t):
    return [x for x in norm(t).split(" ") if len(x) > 1]


def points(q, c):
    """The score of a pair, and whether it is one."""
    _, q_title, q_author, q_isbn, q_languages, q_formats = q
    _, title, subtitle, authors, isbn, language, fmt, size = c
    whole = norm(f"{title or ''} {subtitle or ''}")
    bare = lambda i: norm(i).replace(" ", "")
    same = bool(q_isbn and isbn and bare(q_isbn) == bare(isbn) != "")
    inside = sum(t in whole for t in toks(q_title))
    total = 1000 * same + 180 * (norm(q_title) != "" and whole == norm(q_title)) + 18 * inside + 12 * sum(t in norm(" ".join(authors or [])) for t in toks(q_author))
    languages, formats = q_languages or ["en"], q_formats or ["epub"]
    total += 25 * bool(language and norm(language) in languages)
    total += max(1, 40 - 5 * formats.index(norm(fmt))) if norm(fmt) in formats else 0
    return total + 10 * (size is not None and 10_000 < size < 100 * 1024 * 1024), inside > 0 or same


def brute(queries, candidates, limit):
    out = {}
    for q in queries:
        met = [(-p, c[1] or "", c[0]) for c in candidates for p, pair in [points(q, c)] if pair]
        out[q[0]] = [(i, -p) for p, _, i in sorted(met)[:limit]]
    return out


def frames(spark, queries, candidates):
    return spark.createDataFrame(queries, QUERY), spark.createDataFrame(candidates, CANDIDATE)


def catalogue(n, seed):
    """Half of all titles begin with one word; authors, languages, formats, sizes and ISBNs of all sorts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["art", "cartography", "sea", "island", "of", "crime", "ab", "w1", "w2", "night"])
    out = []
    for i in range(n):
        title = " ".join((["the"] if rng.random() < 0.5 else []) + [word() for _ in range(rng.randint(1, 3))])
        out.append((i, title, rng.choice([None, "", word()]), [rng.choice(["ann lee", "bo", "zed zed"])], rng.choice([None, "", f"978-{i % 7}"]), rng.choice(["en", "fr", "", None]), rng.choice(["epub", "pdf", "mobi", None]), rng.choice([None, 5, 20_000, 20_000])))
    return out + [(n, None, None, None, None, None, None, None), (n + 1, "", "the", [], None, "en", "epub", 20_000)]


QUERIES = [(1, "The Art", "Ann", None, None, None), (2, "the", None, None, ["fr"], ["pdf", "epub"]), (3, "of the the night", "zed", "978 3", [], ["epub"]), (4, "nothing known", None, "9785", None, None), (5, None, None, None, None, None), (6, "ab", "lee", "", ["en", "fr"], ["mobi"]), (7, "Cartography art island", "nobody", None, None, None), (8, "x y", None, None, None, None)]


@pytest.mark.parametrize("block,quota,growth", [(1024, 4096, 8), (4, 8, 2), (16, 20, 3)])
def test_best_candidates_equal_all_pairs(spark, block, quota, growth):
    candidates = catalogue(400, 1)
    q, c = frames(spark, QUERIES, candidates)
    got = {}
    for r in sorted(top_candidates(q, c, 25, block, quota, growth).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = brute(QUERIES, candidates, 25)
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("hot_rows", [50_000, 20])
def test_pairs_are_all_that_share_a_token_or_isbn(spark, hot_rows):
    candidates = catalogue(150, 2)
    q, c = frames(spark, QUERIES, candidates)
    got = sorted((r.query_id, r.id, r.score) for r in search.score(search.blocked_pairs(q, c, hot_rows)).collect())
    assert got == sorted((q[0], c[0], p) for q in QUERIES for c in candidates for p, pair in [points(q, c)] if pair)


@pytest.mark.parametrize("block,quota", [(1024, 4096), (2, 4)])
def test_a_rare_word_does_not_hide_better_candidates_of_a_common_one(spark, block, quota):
    candidates = [(i, f"the w{i}", None, ["a b"], None, "en", "epub", 20_000) for i in range(30)] + [(30, "w7 of nothing", None, ["x"], None, "fr", "pdf", 5)]
    queries = [(1, "The w7", "b b", None, ["en"], ["epub"])]
    q, c = frames(spark, queries, candidates)
    got = [(r.id, r.score) for r in sorted(top_candidates(q, c, 25, block, quota, 2).collect(), key=lambda r: r["rank"])]
    assert got == brute(queries, candidates, 25)[1] and got[0][0] == 7 and len(got) == 25 and 30 not in [i for i, _ in got]


def test_tokens_are_found_inside_words(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))) for _ in range(300)} | {"cartography"})
    found = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(60)} | {"art", "zz"})
    got = search.containing_words(spark.createDataFrame([(t,) for t in found], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, w) for t in found for w in words if t in w)


def test_sources_keep_repeats_and_rank_together(spark):
    candidates = catalogue(60, 4)
    _, c = frames(spark, QUERIES, candidates)
    both = search.all_sources({"a": c, "b": c, "c": c}, ["a", "b", "missing"])
    q = spark.createDataFrame(QUERIES[:1], QUERY)
    got = [(r.id, r.score) for r in sorted(top_candidates(q, both, 12).collect(), key=lambda r: r["rank"])]
    assert got == [x for x in brute(QUERIES[:1], candidates, 6)[1] for _ in range(2)]


def test_nothing_to_search(spark):
    q, c = frames(spark, QUERIES, [])
    assert top_candidates(q, c).count() == 0 and search.blocked_pairs(q, c).count() == 0
    q, c = frames(spark, [], catalogue(5, 5))
    assert top_candidates(q, c).count() == 0
    assert {r.title for r in spark.createDataFrame(catalogue(3, 5), CANDIDATE).select("title").where(F.col("title") == "").collect()} == {""}


def test_unknown_seeds_and_sizes_of_releases_count_as_none(spark):
    h = "a" * 32
    r = spark.createDataFrame([(1, "dune herbert epub", h, None, None), (2, "dune herbert epub", h, 5 << 20, 0), (3, "dune herbert epub", h, 5 << 20, 49), (4, "dune herbert epub", h, 300 << 20, 49), (5, "dune pdf", h, 5, 5)], "id int, name string, hash string, size long, seeds int")
    q = spark.createDataFrame([(1, "Dune", "Herbert")], "query_id int, q_title string, q_author string")
    got = search.release_score(search.gated_pairs(q, r))
    assert {x.id: (x.score, x.fits) for x in got.collect()} == {1: (62, True), 2: (72, True), 3: (121, True), 4: (101, False), 5: (23, False)}
    assert [x.id for x in search.best_release(got, "query_id").collect()] == [3]
    assert [x.id for x in search.best_release(got.where("id < 3"), "query_id").collect()] == [2]


def test_releases_meet_the_queries_whose_rarest_token_they_name(spark):
    names = [(i, f"the {w} hound") for i, w in enumerate(["red", "blue", "red blue", "green"] * 10)]
    r = spark.createDataFrame(names, "id int, name string")
    q = spark.createDataFrame([(1, "Red Hound", "x"), (2, "of it", "Green Blue"), (3, "red missing", "x"), (4, None, None)], "query_id int, q_title string, q_author string")
    for hot_rows in (50_000, 3):
        got = sorted((x.query_id, x.id) for x in search.gated_pairs(q, r, hot_rows).collect())
        assert got == sorted([(1, i) for i, n in names if "red" in n] + [(2, i) for i, n in names if "green" in n or "blue" in n])
