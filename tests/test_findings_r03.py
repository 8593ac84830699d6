"""What the review of round 3 found: twins on odd pages, and steps that grew with the tables."""

import pytest

duckdb = pytest.importorskip("duckdb")


def _twin(name: str, tables: dict) -> list:
    from quillspark.plans import catalog

    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return sorted(con.execute(catalog.sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["F2_page_headings", "F1_F5_F6_page_blocks", "WN1_WN2_WN3_WN4_chapters"])
def test_references_without_semicolon(spark, tmp_path, name):
    from quillspark.plans import catalog

    page = "<html><body><article><h1>One&amp;&amp{}</h1><p>" + "word &lt; word " * 300 + "cut &quot</p></article></body></html>"
    rows = [(i, f"https://a.example/en/{i}", page.format(cut)) for i, cut in enumerate(["", "&lt", "&gt", "&am", "&amp;lt"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    assert got == _twin(name, {"pages": f"{tmp_path}/pages.parquet"}) and len(got) >= 5


def test_lookahead_multiplies_no_anchors(spark):
    """The anchors were copied to every deal, and by their statistics before that sent to all tasks through the driver."""
    from quillspark.operators import sequence as S

    segments = spark.createDataFrame([(c, i, "pending" if i % 2 else "voiced") for c in (1, 2) for i in range(1, 9)], "chapter_id long, segment_index int, status string")
    chapters = spark.createDataFrame([(1, 7, 1), (2, 7, 2)], "chapter_id long, book_id long, chapter_index int")
    anchors = spark.createDataFrame([(7, 1, 6)], "book_id long, chapter_index int, segment_index int")
    found = S.lookahead(segments, chapters, anchors)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 1, 7, 1), (7, 2, 1, 2), (7, 2, 3, 3), (7, 2, 5, 4)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin [book_id" in plan


def test_python_holds_pieces_of_a_batch():
    """A worker turned a whole batch into Python objects at once."""
    import pyarrow as pa

    from quillspark.sources.batches import pieces

    batch = pa.RecordBatch.from_pydict({"n": list(range(1000)), "t": ["x" * (5000 if i == 7 else i) for i in range(1000)]})
    parts = list(pieces(batch, 4096))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert all(p.nbytes <= 4096 or len(p) == 1 for p in parts) and len(parts) > 100
    assert [len(p) for p in pieces(batch.slice(0, 0))] == [0]


def test_packing_and_decomposing_in_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillspark.operators import packing, pages, search

    for module in (packing, pages, search):
        assert "pd" not in vars(module), "whole batches as pandas"
    texts = [None, "", "Ça va? É à Ü ﬁn", *("é" * i for i in range(50))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    got = {r.id: r.d for r in df.select("id", search.decomposed(F.col("t")).alias("d")).collect()}
    assert got == dict(enumerate([None, "", "Ca va? E a U fin", *("e" * i for i in range(50))]))
    rows = spark.createDataFrame([(None, [("narration", "One two. Three.")]), (2, None), (3, [("heading", "H"), (None, None), ("dialogue", "“Hi”")])], "id int, blocks array<struct<type:string,text:string>>")
    assert sorted(map(str, packing.segments(rows).collect())) == [
        "Row(id=3, segment_index=1, raw_text='H', n_words=1, is_scene_break=False)", "Row(id=3, segment_index=2, raw_text='“Hi”', n_words=1, is_scene_break=False)",
        "Row(id=None, segment_index=1, raw_text='One two. Three.', n_words=3, is_scene_break=False)"]


def test_gated_pairs_meet_once_without_a_distinct_over_pairs(spark):
    from quillspark.operators import search

    queries = spark.createDataFrame([(1, "red book", "ann"), (2, "of it", "ann lee ann zoe"), (3, "gone", "ann")], "query_id long, q_title string, q_author string")
    releases = spark.createDataFrame([(1, "Red book ann"), (2, "lee ann zoe red"), (3, "zoe"), (3, "zoe lee"), (4, "other")], "id long, name string")
    for hot in (1, 50_000):
        pairs = search.gated_pairs(queries, releases, hot)
        got = sorted((r.query_id, r.id, r.name) for r in pairs.collect())
        assert [g for g in got if g[0] == 2] == [(2, 1, "Red book ann"), (2, 2, "lee ann zoe red"), (2, 3, "zoe"), (2, 3, "zoe lee")]
        assert [g for g in got if g[0] == 1] == [(1, 1, "Red book ann")] and not [g for g in got if g[0] == 3]
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [query_id" not in plan or "Aggregate [query_id#" in plan and ", id#" not in plan.split("Aggregate [query_id", 1)[1].split("]")[0]


def test_all_pairs_meet_once_without_a_distinct_over_pairs(spark):
    """All pairs were told apart by a distinct, and joined to the candidates after it."""
    from quillspark.operators import search

    lists = "q_languages array<string>, q_formats array<string>"
    q = spark.createDataFrame([(1, "red book", "", "9781", [], []), (2, "oo ed", "", None, [], []), (3, "", "", "978-3", [], []), (4, "gone", "", "9785", [], [])], f"query_id long, q_title string, q_author string, q_isbn string, {lists}")
    titles = ["Red red book", "a book", "Booked", "of it", "red", None, "r e d"]
    c = spark.createDataFrame([(i, t, None, ["x"], f"978{i}", None, None, None) for i, t in enumerate(titles)], "id long, title string, subtitle string, authors array<string>, isbn string, language string, format string, filesize long")
    for hot in (1, 50_000):
        pairs = search.blocked_pairs(q, c, hot)
        assert sorted((r.query_id, r.id) for r in pairs.collect()) == [(1, 0), (1, 1), (1, 2), (1, 4), (2, 0), (2, 1), (2, 2), (2, 4), (3, 3), (4, 5)]
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate [query_id" in line and "_row" in line for line in plan.splitlines())


def test_candidates_are_not_sent_through_the_driver(spark):
    """Written candidates are small beside what they hold in memory; by their size each round sent them to all tasks."""
    from quillspark.operators import search
    from quillspark.operators.top_candidates import top_candidates

    lists = "q_languages array<string>, q_formats array<string>"
    q = spark.createDataFrame([(1, "red book", "", "9781", [], [])], f"query_id long, q_title string, q_author string, q_isbn string, {lists}")
    c = spark.createDataFrame([(i, t, None, ["x"], f"978{i}", None, None, None) for i, t in enumerate(["Red book", "other"])], "id long, title string, subtitle string, authors array<string>, isbn string, language string, format string, filesize long")
    best = top_candidates(q, c)
    numbers = search.isbn_pairs(search.prepared_queries(q), search.prepared_candidates(c).withColumn("_row", search.F.col("id")))
    for joined in (best, numbers):
        assert "rightHint=(strategy=merge)" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r["rank"]) for r in best.orderBy("rank").collect()] == [(1, 1), (0, 2)]


def test_texts_are_not_dealt_by_their_few_languages(spark, tmp_path):
    """A task got all texts of a language."""
    from quillspark.plans import catalog

    rows = [(i, lang, f"The {lang} der und le de {i}") for i, lang in enumerate(["en", "de", "fr", "es", None, "xx"] * 3)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["F19_AG11_dictionary"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == _twin("F19_AG11_dictionary", {"documents": f"{tmp_path}/documents.parquet"})
    assert "rightHint=(strategy=broadcast)" in found._jdf.queryExecution().optimizedPlan().toString()


def test_seek_aggregates_without_sorting_segments(spark):
    """Least and largest structs were aggregated by a sort of all segments."""
    from quillspark.operators import sequence as S

    rows = [(1, 1, 0), (1, 2, 100), (1, 3, 300), (1, 4, None), (2, 1, None), (2, 2, 0)]
    segments = spark.createDataFrame([(*r, "voiced") for r in rows], "chapter_id long, segment_index int, duration_ms int, status string")
    ratios = spark.createDataFrame([(1, 0.0), (1, 0.25), (1, 0.5), (1, 1.5), (2, 0.5)], "chapter_id long, ratio double")
    found = S.seek(segments, ratios)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 0.0), (1, 2, 100.0), (1, 3, 100.0), (1, 4, 200.0), (2, 2, 0.0)]
    assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString()
