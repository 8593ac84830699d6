"""Running values in parts against plain folds, and the operators that rest on them on a book cut into many parts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import pages, scan, sequence

WIDTHS = [1, 3, 4096]


@pytest.mark.parametrize("width", WIDTHS)
def test_running_values_equal_windows(spark, width):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, *range(9)])) for k in "abc" for i in rng.sample(range(60), {"a": 50, "b": 7, "c": 1}[k])] + [(None, 1, 5), ("a", None, 5)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    by = Window.partitionBy("k").orderBy("i")
    past, upto, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero, v = lambda c: F.coalesce(c, F.lit(0)), F.col("v")
    want = df.where("k IS NOT NULL AND i IS NOT NULL").select("k", "i", "v", zero(F.sum("v").over(upto)), zero(F.sum("v").over(past)), F.last("v", ignorenulls=True).over(past), F.sum("v").over(all_), F.last("v").over(all_), F.row_number().over(by))
    got = scan.running(df, "k", "i", width, a=scan.total(v), b=scan.before(v), c=scan.latest(v), d=scan.whole(v), e=scan.final(v), f=scan.total(F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def segments(spark):
    rng = random.Random(2)
    rows = [(c, i, rng.choice(["voiced", "voiced", "queued", "failed", "pending"]), rng.choice([0, 100, 900]), rng.random() < 0.3) for c, n in ((1, 40), (2, 3), (3, 1)) for i in range(1, n + 1)]
    rows = [(c, i, s, d if s == "voiced" else None, b) for c, i, s, d, b in rows]
    return rows, spark.createDataFrame(rows, "chapter_id int, segment_index int, status string, duration_ms int, is_scene_break boolean")


@pytest.mark.parametrize("width", WIDTHS)
def test_timelines_equal_a_fold(spark, width):
    rows, df = segments(spark)
    want, end, last = {}, {}, {}
    for c, i, s, d, b in rows:
        if s == "voiced":
            gap = 0 if c not in last else 700 if last[c] else 350
            want[c, i] = (gap, end.get(c, 0) + gap)
            end[c], last[c] = end.get(c, 0) + gap + d, b
    got = {(r.chapter_id, r.segment_index): (r.gap_ms, r.start_ms, r.chapter_ms) for r in sequence.timeline(df, width).collect()}
    assert got == {(c, i): (*v, end[c]) for (c, i), v in want.items()}


@pytest.mark.parametrize("width", WIDTHS)
def test_positions_equal_a_fold(spark, width):
    rows, df = segments(spark)
    places = [(c, p) for c in (1, 2, 3) for p in (0, -5, 100, 950, 4000, 10**6)]
    want = []
    for c, p in places:
        mine, end, hit = [r for r in rows if r[0] == c], 0, None
        for _, i, _, d, _ in mine:
            end += d or 0
            hit = i if hit is None and d and end > p else hit
        land = 0 if p <= 0 else hit or mine[-1][1]
        plays = [i for _, i, s, _, _ in mine if s == "voiced"]
        want.append((c, p, next((i for i in plays if i >= land), plays[0] if plays else None)))
    got = sequence.resume_at(df, spark.createDataFrame(places, "chapter_id int, position_ms int"), width)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    want = []
    for c, ratio in ((1, 0.5), (1, 1.0), (2, 0.0), (3, 0.3)):
        mine, end = [r for r in rows if r[0] == c], 0
        target, spans = ratio * sum(d or 0 for *_, d, _ in mine), []
        for _, i, _, d, _ in mine:
            spans.append((i, end, end + (d or 0)))
            end += d or 0
        i, start, _ = next((x for x in spans if x[2] > x[1] and x[2] >= target), spans[-1])
        want.append((c, i, max(0.0, target - start)))
    got = sequence.seek(df, spark.createDataFrame([(1, 0.5), (1, 1.0), (2, 0.0), (3, 0.3)], "chapter_id int, ratio double"), width).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_lookahead_takes_a_books_first_open_segments(spark):
    rng = random.Random(3)
    chapters = [(c, c % 2, c) for c in range(1, 41)]
    segs = [(c, i, rng.choice(["voiced", "queued", "failed", "pending"])) for c, _, _ in chapters for i in range(1, 6)]
    anchors = [(0, 5, 3), (1, 7, 1)]
    want = []
    for b, ac, ai in anchors:
        open_ = sorted((ci, i, c, s) for c, book, ci in chapters if book == b for c2, i, s in segs if c2 == c and s not in ("voiced", "failed") and (ci, i) >= (ac, ai))[:4]
        want += [(b, c, i, n) for n, (_, i, c, s) in enumerate(open_, 1) if s == "pending"]
    got = sequence.lookahead(spark.createDataFrame(segs, "chapter_id int, segment_index int, status string"), spark.createDataFrame(chapters, "chapter_id int, book_id int, chapter_index int"), spark.createDataFrame(anchors, "book_id int, chapter_index int, segment_index int"))
    assert sorted(map(tuple, got.select("book_id", "chapter_id", "segment_index", "place").collect())) == sorted(want)


@pytest.mark.parametrize("width", WIDTHS)
def test_chapters_of_a_book_in_parts(spark, width):
    prose = "He walked on and the road was long and nothing moved there. " * 10
    rng, rows = random.Random(4), []
    for book, n in (("hot", 60), ("cold", 4), ("thin", 2)):
        for i in range(1, n + 1):
            kind = rng.choice(["", "", "", "Chapter X", "Notes", "Contents", "short"])
            body = "<p>few words</p>" if kind == "short" else f"<h1>{kind}</h1><p>{prose}</p>"
            rows.append((book, i, f"p{i}.xhtml", f"<html><body>{body}</body></html>"))
    want, words = [], len(prose.split())
    for book in ("hot", "cold", "thin"):
        mine, before, over, begun, kept = [r for r in rows if r[0] == book], 0, False, False, []
        for place, (_, i, path, html) in enumerate(mine, 1):
            heading = html.split("<h1>")[1].split("</h1>")[0] if "<h1>" in html else ""
            n = (words if prose in html else 2) + len(heading.split())
            over = over or heading == "Notes" and place / len(mine) >= 0.6 and before >= 500
            counted = heading != "Contents"
            if counted and not over and n > 50:
                begun = begun or heading.startswith("Chapter") or n >= 400
                if begun:
                    kept.append((heading, path, n))
            before += n if counted else 0
        if sum(n for _, _, n in kept) >= 500:
            want += [(book, k, h or f"Chapter {k}", path, n) for k, (h, path, n) in enumerate(kept, 1)]
    got = pages.chapters(spark.createDataFrame(rows, "book_id string, spine_index int, path string, html string"), width=width)
    assert sorted((r.book_id, r.chapter_index, r.title, r.path, r.words) for r in got.collect()) == sorted(want) and len(want) > 20
