"""Operators against plain folds and literal rows."""

import random
import time

from pyspark.sql import functions as F

from quillspark.operators import annotations, packing, pages, status
from quillspark.sources import sinks
from quillspark.streaming import keyed


def test_packing_keeps_all_words_in_order_within_budgets():
    rng = random.Random(1)
    for _ in range(50):
        blocks = []
        for _ in range(rng.randint(0, 40)):
            words = [rng.choice(["a", "bb.", "Cc", "dd,", "ee!"]) for _ in range(rng.choice([1, 5, 11, 60, 320, 700]))]
            blocks.append((rng.choice(["narration", "dialogue", "heading"]), " ".join(words)))
        made = packing.pack(blocks)
        assert " ".join(t for t, _ in made).split() == " ".join(t for _, t in blocks).split()
        assert all(len(u.split()) <= 300 for _, t in blocks for u in packing.units(t))


def test_packing_rules():
    long = "word " * 650
    assert all(len(t.split()) <= 300 for t, _ in packing.pack([("narration", long)])) and len(packing.pack([("narration", long)])) >= 2
    assert packing.pack([("narration", "One."), ("narration", "* * *"), ("narration", "Two.")]) == [("One.", True), ("Two.", False)]
    assert packing.pack([("narration", "***"), ("narration", "Two.")]) == [("Two.", False)]  # nothing held: the break is lost
    assert packing.pack([("heading", "I"), ("narration", "Go on.")]) == [("I", False), ("Go on.", False)]
    lead = " ".join(["w"] * 69) + "."
    assert [len(t.split()) for t, _ in packing.pack([("narration", lead), ("narration", " ".join(["v"] * 100) + "."), ("narration", " ".join(["u"] * 99) + ".")])] == [69, 199]


def test_packing_job_handles_empty_chapters(spark):
    rows = spark.createDataFrame([(1, [("narration", "A b.")]), (2, []), (3, None)], "chapter_id int, blocks array<struct<type:string,text:string>>")
    made = packing.segments(rows)
    assert [(r.chapter_id, r.segment_index, r.raw_text) for r in made.collect()] == [(1, 1, "A b.")]
    chapters, _ = packing.structured_book(rows, made)
    assert {r.chapter_id: (r.total_count, r.status) for r in chapters.collect()} == {1: (1, "queued"), 2: (0, "failed"), 3: (0, "failed")}


def test_annotations_of_wrong_types(spark):
    json = [
        '{"scene_summary":3,"beats":[{"text":"a","delivery":{"intensity":9,"pace":"warp","style":7}},{"text":5},{"text":""},"x"]}',
        '[{"text":"b","speaker_cast_id":"z"}]', "nonsense", None, '{"beats":[]}', '{"beats":[' + ",".join(['{"text":"t"}'] * 13) + "]}",
    ]
    rows = spark.createDataFrame([(i, j, "raw") for i, j in enumerate(json)], "i int, annotated_json string, raw_text string")
    got = annotations.cleaned(rows).orderBy("i").collect()
    assert [len(r.beats) for r in got] == [1, 1, 1, 1, 1, 12]
    assert [r.beats[0].text for r in got] == ["a", "b", "raw", "raw", "raw", "t"]
    assert got[0].beats[0].delivery.asDict() == {"style": annotations.STYLE, "emotion": annotations.EMOTION, "intensity": 1.0, "pace": "normal"}
    assert got[0].scene_summary == annotations.SUMMARY


def test_dictionary_edges(spark):
    rows = spark.createDataFrame([("Mr. Darcy, mr. X; smr. cat cats", [(1, "Mr.", "Mister $1"), (2, "cat", "dog"), (3, "dog", "co\\w")])], "t string, d array<struct<pos:int,term:string,hint:string>>")
    assert rows.select(annotations.substituted(F.col("t"), F.col("d"))).first()[0] == "Mister $1 Darcy, Mister $1 X; smr. co\\w cats"


def test_long_dictionaries_by_an_automaton(spark):
    rng = random.Random(11)
    terms = [("a", i, f"w{i}", f"w{i + rng.choice([1, 2])} x") for i in range(0, 1000, 3)] + [("a", 1000, "x x", "yy"), ("a", 1001, "W5", "$1\\"), ("b", 1, "", "-"), ("b", 2, "the", "a"), ("c", 1, "the", None), (None, 1, "the", "z")]
    texts = [(i, rng.choice("abcd"), " ".join(rng.choice(["w%d" % rng.randint(0, 999), "W3.", "the", "xw6", "é", "ſ"]) for _ in range(8))) for i in range(80)] + [(90, "a", None), (91, None, "the"), (92, "a", ""), (93, "b", "")]
    df, words = spark.createDataFrame(texts, "i int, k string, text string"), spark.createDataFrame(terms, "k string, pos int, term string, hint string")
    want = df.join(annotations.dictionaries(words.where("k IS NOT NULL"), "k"), "k", "left").select("i", annotations.substituted(F.col("text"), F.col("dictionary")).alias("t"))
    got = annotations.substitute(df, words, "k", deals=3)
    assert got.columns == df.columns and {r.i: r.text for r in got.collect()} == {r.i: r.t for r in want.collect()}


PROSE = "He walked on and the road was long and nothing moved there. " * 50


def page(book, i, path, body):
    return (book, i, path, f"<html><head><title>t</title></head><body>{body}</body></html>")


def test_pages_become_chapters(spark):
    rows = [
        page("b", 1, "copyright.xhtml", f"<p>{PROSE}</p>"),
        page("b", 2, "p2.xhtml", "<p>For my mother</p>"),
        page("b", 3, "toc2.xhtml", "<nav>" + "".join(f"<a href='#'>Chapter {i}</a>" for i in range(9)) + "</nav>"),
        page("b", 4, "c1.xhtml", f"<h2>Chapter One</h2><p>{PROSE}</p><script>x</script><p>12</p>"),
        page("b", 5, "c2.xhtml", f"<p>{PROSE}</p>"),
        page("b", 6, "end.xhtml", f"<h1>Notes</h1><p>{PROSE}</p>"),
        page("b", 7, "more.xhtml", f"<p>{PROSE}</p>"),
        page("c", 1, "a.xhtml", "<p>short</p>"), ("c", 2, "b.xhtml", None),
    ]
    df = spark.createDataFrame(rows, "book_id string, spine_index int, path string, html string")
    got = pages.chapters(df).orderBy("chapter_index").collect()
    assert [(r.book_id, r.chapter_index, r.title, r.path) for r in got] == [("b", 1, "Chapter One", "c1.xhtml"), ("b", 2, "Chapter 2", "c2.xhtml")]


def test_leading_contents_are_cut(spark):
    body = "<p>Contents</p><p>Chapter 1</p><p>Chapter 2</p><p>Chapter 3</p>" + f"<p>{PROSE}</p>"
    df = spark.createDataFrame([page("b", 1, "prologue.xhtml", body)], "book_id string, spine_index int, path string, html string")
    assert [len(r.blocks) for r in pages.page_facts(df).collect()] == [1]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 5, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted((r.k, r.x) for r in sinks.upsert(old, new, ["k"], "v").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    assert sorted((r.k, r.x) for r in sinks.insert_if_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "e")]


def fold(events, span):
    out, opened, count = {}, {}, {}
    for i, key, t in sorted(events, key=lambda e: (e[2], e[0])):
        if key not in opened or t >= opened[key] + span:
            opened[key], count[key] = t, 0
        count[key] += 1
        out[i] = (count[key], count[key] == 1)
    return out


def test_anchored_windows_as_batch_and_as_stream(spark, tmp_path):
    rng = random.Random(2)
    events = [(i, rng.choice("abc"), rng.randint(0, 4000)) for i in range(300)]
    want = fold(events, 900)
    df = spark.createDataFrame(events, "event_id long, k string, s long").select("event_id", "k", F.timestamp_seconds("s").alias("ts"))
    batch = {r.event_id: (r.in_window, r.opens) for r in keyed.anchored(df, "k", 900).collect()}
    assert batch == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = keyed.anchored_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", 900)
    q = stream.writeStream.format("memory").queryName("anchored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: (r.in_window, r.opens) for r in spark.table("anchored").collect()} == want


def test_hot_keys_have_the_same_windows(spark):
    rng = random.Random(9)
    events = [(i, k, rng.choice([t, t // 300 * 300, 7000 + t // 50])) for i, (k, t) in enumerate((rng.choice("aaab"), rng.randint(0, 6000)) for _ in range(500))] + [(900, "c", 5), (901, None, 6), (902, "a", 40_000)]
    want = fold([e for e in events if e[1]], 170)
    df = spark.createDataFrame(events, "event_id long, k string, s long").select("event_id", "k", F.timestamp_seconds("s").alias("ts"))
    for hot_rows in (1, 200):
        got = keyed.anchored(df, "k", 170, hot_rows=hot_rows)
        starts = {(r.k, r.window_start): r.event_id for r in got.where("opens").collect()}
        assert {r.event_id: (r.in_window, r.opens) for r in got.collect()} == want
        assert all((r.k, r.window_start) in starts for r in got.collect())
    forced = F.col("event_id") % 10 == 3
    assert sorted(r.event_id for r in keyed.throttled(df, "k", 170, forced, hot_rows=5).collect()) == sorted(r.event_id for r in keyed.throttled(df, "k", 170, forced).collect())


def read(body):
    return pages.read_page(f"<html><body>{body}</body></html>")


def test_page_breaks_and_note_marks_go_with_all_inside():
    texts = lambda body: [b["text"] for b in read(body)[0]]
    assert texts("<p>a</p><div class='page'><p>Page 14</p></div><p class='x pagebreak'>15</p><span epub:type='pagebreak'><p>16</p></span><p class='pages'>b</p>") == ["a", "b"]
    assert texts("<p>word<sup><span><a href='#n'>7</a></span></sup> end x<sup>2</sup></p>") == ["word end x2"]
    assert pages.read_page("<p>no body at all</p>")[0] == [] and read("<p>one</p>")[3] == ""


def test_block_types_read_classes_and_kinds(spark):
    body = "<p epub:type='poem'>Kind only.</p><p class='a-poem'>Verse.</p><p epub:type='footnote'>Note.</p><p class='epistle'>Dear you.</p><p epub:type='letter'>Not one.</p><blockquote>Said.</blockquote><h4>Head</h4>"
    df = spark.createDataFrame([page("b", 1, "c1.xhtml", body)], "book_id string, spine_index int, path string, html string")
    assert [b.type for b in pages.parsed(df).select(pages.typed_blocks(F.lit("")).alias("b")).first().b] == ["narration", "poem", "footnote", "letter", "narration", "poem", "heading"]


def test_short_books_have_no_chapters(spark):
    body = f"<h1>Chapter 1</h1><p>{'few words here ' * 40}</p>"
    df = spark.createDataFrame([page("b", 1, "c1.xhtml", body)], "book_id string, spine_index int, path string, html string")
    assert pages.chapters(df).count() == 0


def test_reading_order_drops_pages_out_of_line(spark):
    df = spark.createDataFrame([("b", 1, "no", "a"), ("b", 2, None, "b"), ("b", 3, "yes", "c"), ("b", 4, "NO", "d")], "book_id string, spine_index int, linear string, path string")
    assert sorted((r.spine_index, r.path) for r in sinks.reading_order(df).collect()) == [(1, "b"), (2, "c")]


def test_block_tags_end_a_paragraph():
    texts = lambda body: [b["text"] for b in read(body)[0]]
    assert texts("<p>three<div>four</div><p>five") == ["three", "five"]
    assert texts("<p>a<ul><li>b</li></ul><p>c<section>d</section>") == ["a", "c"]
    assert texts("<p>a<span>b<p>c") == ["abc", "c"]  # the open span holds the rest


def test_only_the_first_contents_list_counts(spark):
    links = lambda n: "".join(f"<a href='#'>x{i}</a>" for i in range(n))
    bodies = [
        f"<nav>{links(4)}</nav><nav>{links(4)}</nav>", f"<nav>{links(2)}</nav><p>{PROSE}</p><div class='a toc'>{links(9)}</div>", f"<div class='a toc'>{links(8)}</div>",
        f"<div epub:type='toc x'>{links(9)}</div>", f"<div epub:type='toc'>{links(9)}</div>", f"<div class='page'><nav>{links(2)}</nav></div><nav>{links(9)}</nav>",
    ]
    df = spark.createDataFrame([page("b", i, "c.xhtml", b) for i, b in enumerate(bodies)], "book_id string, spine_index int, path string, html string")
    assert {r.spine_index: r.link_list for r in pages.page_facts(df).collect()} == {0: False, 1: False, 2: True, 3: False, 4: True, 5: True}


def test_sessions_of_exactly_the_greatest_age_hold(spark):
    rows = spark.createDataFrame([(1, "u", 7 * 86_400), (2, "u", 7 * 86_400 + 1), (3, "v", 5)], "i int, user_id string, age int")
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    sessions = rows.select("i", "user_id", (as_of - F.make_interval(secs="age")).alias("created_at"), (as_of + F.make_interval(days=F.lit(1))).alias("expires_at"))
    users = spark.createDataFrame([("u", False), ("v", True)], "user_id string, disabled boolean")
    assert [r.i for r in status.valid_sessions(sessions, users, as_of).collect()] == [1]


def test_submission_kinds(spark):
    books = spark.createDataFrame([(1, "u", "h1", "ready", None), (2, "u", "h2", "failed", "k"), (3, "u", "h3", "failed", None), (4, "v", "h4", "ready", "k")], "book_id int, user_id string, source_hash string, status string, file_key string")
    new = spark.createDataFrame([("u", "h1"), ("u", "h2"), ("u", "h3"), ("u", "h4")], "user_id string, source_hash string")
    assert {r.source_hash: r.kind for r in status.submissions(new, books).collect()} == {"h1": "existing", "h2": "retryable", "h3": "conflict", "h4": "new"}


def test_keys_by_name_and_by_column(spark):
    books = spark.createDataFrame([(1, "u", "cov", "file")], "book_id int, user_id string, cover_key string, file_key string")
    chapters = spark.createDataFrame([(5, 1, "ch")], "chapter_id int, book_id int, audio_key string")
    segments = spark.createDataFrame([(5, "seg"), (5, None)], "chapter_id int, audio_key string")
    keys = spark.createDataFrame([(k,) for k in ("books/1/x", "books/2/x", "cov", "file", "ch", "seg", "none")], "key string")
    two = books.union(spark.createDataFrame([(2, "w", "cov", None), (3, "u", "cov", None)], books.schema))
    assert sorted((r.key, r.owner) for r in status.key_owners(keys.where("key = 'cov'"), two, chapters, segments, "^books/([0-9]+)/").collect()) == [("cov", "u"), ("cov", "w")]
    got = {r.key: r.owner for r in status.key_owners(keys, books, chapters, segments, "^books/([0-9]+)/").collect()}
    assert got == {"books/1/x": "u", "books/2/x": None, "cov": "u", "file": "u", "ch": "u", "seg": "u", "none": None}


def test_forced_events_pass_a_throttle_without_a_mark(spark):
    df = spark.createDataFrame([(i, "k", t, f) for i, (t, f) in enumerate([(0, False), (5, True), (9, False), (10, False), (12, True), (19, False), (20, False)])], "event_id long, k string, s long, f boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.event_id for r in keyed.throttled(df, "k", 10, F.col("f")).collect()) == [0, 1, 3, 4, 6]


def streamed(spark, tmp_path, df, make, mode="append", files=6):
    """All that a stream over ``df`` emits, its rows in as many files in order of time, a file a micro-batch."""
    rows = df.orderBy("ts", "event_id").collect()
    folder = tmp_path / "in"
    for i in range(files):
        spark.createDataFrame(rows[i * len(rows) // files : (i + 1) * len(rows) // files], df.schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"s{abs(hash(str(tmp_path)))}"
    q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def event_rows(spark, n=240):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcd"), 60 + i * 60 + rng.randint(0, 40), rng.choice(["discovering", "in_progress", "segment_ready", "ready", "failed", "voiced"]), rng.choice([None, 5, 7]), rng.choice([None, "x", "y"]), rng.choice([None, 0, 3, 9]), rng.choice([1, 2, 8]), rng.randint(0, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, k string, s long, status string, duration_ms int, audio_key string, total int, done int, part int").withColumn("ts", F.timestamp_seconds("s"))


def test_current_state_as_batch_and_as_stream(spark, tmp_path):
    df = event_rows(spark)
    last = {}
    for r in streamed(spark, tmp_path, df, lambda s: keyed.current_stream(s, "k"), "update"):
        last[r.k] = r
    for r in keyed.current_status(df, "k").collect():
        assert (r.status, r.duration_ms, r.audio_key) == (last[r.k].status, last[r.k].duration_ms, last[r.k].audio_key)
    assert {r.k: r.total for r in keyed.progress(df, "k").collect()} == {k: r.total for k, r in last.items()}
    assert all(r.done <= r.total for r in last.values() if r.total)


def test_progress_without_a_total_keeps_done(spark):
    df = spark.createDataFrame([(1, "k", 0, 5), (2, "m", 3, 5), (3, "n", 9, 5)], "event_id long, k string, total int, done int").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {r.k: (r.total, r.done) for r in keyed.progress(df, "k").collect()} == {"k": (0, 5), "m": (3, 3), "n": (9, 5)}


def test_counters_as_batch_and_as_stream(spark, tmp_path):
    df = event_rows(spark)
    total = {}
    for r in streamed(spark, tmp_path, df, lambda s: keyed.once_only_stream(s, "k", "part")):
        v, f = total.get(r.k, (0, 0))
        total[r.k] = v + r.voiced, f + r.failed
    assert total == {r.k: (r.voiced, r.failed) for r in keyed.once_only(df, "k", "part").collect()}


def test_submissions_as_batch_and_as_stream(spark, tmp_path):
    df, submits, ends = event_rows(spark), F.col("status").isin("discovering", "in_progress"), F.col("status").isin("ready", "failed")
    got = streamed(spark, tmp_path, df, lambda s: keyed.accepted_stream(s, "k", submits, ends))
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in keyed.accepted_submissions(df, "k", submits, ends).collect())


def test_stuck_keys_are_found_by_the_watermark(spark, tmp_path):
    rows = [(1, "a", 5, "discovering"), (2, "b", 10, "discovering"), (3, "b", 600, "ready"), (4, "c", 20, "discovering"), (5, "d", 30, "discovering"), (6, "z", 9000, "ready"), (7, "z", 20_000, "ready"), (8, "z", 30_000, "ready")]
    df = spark.createDataFrame(rows, "event_id long, k string, s long, status string").withColumn("ts", F.timestamp_seconds("s"))
    got = streamed(spark, tmp_path, df, lambda s: keyed.stuck_stream(s, F.col("k") == "d", key="k"), files=8)
    assert sorted((r.k, int(r.since.timestamp())) for r in got) == [("a", 5), ("c", 20)]


def test_upserts_of_a_stream_are_a_log_that_does_not_grow(spark, tmp_path):
    schema, where = "k long, v long, x string", str(tmp_path / "t")
    want, sizes, rng = {}, [], random.Random(5)
    for i in range(7):
        rows = [(rng.randint(0, 9), rng.choice([None, i, i - 1]), f"b{i}-{j}") for j in range(12)] + [(i, 100 + i, "own")] * 2
        for k, v, x in rows:
            want[k] = max((y for y in (want.get(k), v) if y is not None), default=None)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sinks.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), where, str(tmp_path / "c"), ["k"], "v", every=3).awaitTermination(180)
        got = {r.k: r.v for r in sinks.upserted(spark, where, schema, ["k"], "v").collect()}
        assert got == want
        sizes.append(sum(1 for _ in (tmp_path / "t").rglob("*.parquet")))
    assert sinks.log_parts(spark, where) == (5, [6]) and max(sizes) <= 2 + 2 * 3 + 2 * 3  # two bases, the deltas and names of two rounds
    assert {r.k for r in sinks.upserted(spark, where, schema, ["k"], "v", 5).collect()} <= set(want)


def test_structured_books_are_written_in_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(c, 1, [("narration", "word " * 400)]) for c in range(20)] + [(99, 1, [])], "chapter_id long, book_id int, blocks array<struct<type:string,text:string>>")
    made = packing.segments(rows)
    chapters, segments = packing.structured_book(rows, made)
    sinks.write_structured(chapters, segments, str(tmp_path), 4)
    back = spark.read.parquet(str(tmp_path / "segments"))
    assert sorted(map(tuple, back.select(segments.columns).collect())) == sorted(map(tuple, segments.collect()))
    assert back.withColumn("file", F.input_file_name()).groupBy("chapter_id").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0 and len(list((tmp_path / "segments").glob("bucket=*"))) <= 4
    assert spark.read.parquet(str(tmp_path / "chapters")).where("status = 'failed'").count() == 1


def test_page_files_are_a_row_each(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.xhtml").write_text(f"<p>{n}\n2</p>")
    assert sorted((r.path[-7:], r.html) for r in sinks.page_files(spark, str(tmp_path / "*.xhtml")).collect()) == [("a.xhtml", "<p>a\n2</p>"), ("b.xhtml", "<p>b\n2</p>")]
