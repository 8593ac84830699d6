"""Queries of text functions, segment packing, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import formats, text
from quillspark.operators import packing
from quillspark.operators import status as O
from quillspark.plans import packing_sql
from quillspark.plans.registry import query
from quillspark.sources import model as M
from quillspark.sources import sinks
from quillspark.sources.model import with_model
from quillspark.sources.shared import Steps


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, line) of all documents."""
    return M.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"
DIALOGUE = "(starts_with(trim(line), '\"') OR ends_with(trim(line), '\"') OR starts_with(trim(line), '''') OR ends_with(trim(line), '''') OR starts_with(trim(line), '—') OR starts_with(trim(line), '- '))"
WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


def chapter_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chapters: (book_id, chapter_id, blocks)."""
    kind = lambda t: F.when(text.is_dialogue(t), "dialogue").otherwise("narration")
    blocks = F.transform(F.split("text", "\n"), lambda t: F.struct(kind(t).alias("type"), t.alias("text")))
    return M.chapter_texts(spark, d).select("book_id", "chapter_id", blocks.alias("blocks"))


@query("F3_clean_text", r"SELECT doc_id, md5(translate(trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\[\d+\]', '', 'g')), '“”‘’', '""''''')) AS cleaned_md5 FROM documents")
def f3(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("cleaned_md5"))


@query("F4_dialogue_lines", f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({DIALOGUE}) AS n_dialogue FROM lines GROUP BY doc_id")
def f4(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.is_dialogue(F.col("line"))).alias("n_dialogue"))


@query("F7_AG4_word_totals", f"SELECT source AS book_id, count(*) AS n_chapters, CAST(sum({WORDS.format('text')}) AS BIGINT) AS n_words FROM documents GROUP BY source HAVING sum({WORDS.format('text')}) >= 500")
def ag4(spark, d):
    c = M.chapter_texts(spark, d)
    return c.groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum(text.count_words(F.col("text"))).alias("n_words")).where("n_words >= 500")


_PROTECT = "(^|[^A-Za-z0-9_])(" + "|".join(text.ABBREVIATIONS) + r")\."


@query("F8_sentences", f"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10) || chr(10))) AS sentences_md5 FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '{_PROTECT}', '\\1\\2' || chr(57344), 'g'),
'([.!?])\\s+([A-Z"“''‘—])', '\\1' || chr(57345) || '\\2', 'g'), chr(57344), '.', 'g'), chr(57345)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents)""")
def f8(spark, d):
    s = M.spread(M.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n\n").cast("binary")).alias("sentences_md5"))


_TOC = " OR ".join(f"regexp_matches(trim(line), '(?i){p}')" for p in text.TOC_LINES)


@query("F10_F11_line_classes", f"""WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches(trim(line), '^(\\*\\s*){{3,}}$') OR trim(line) IN ('---', '___')) AS n_breaks,
count(*) FILTER (trim(line) <> '' AND length(trim(line)) <= 120 AND ({_TOC})) AS n_toc FROM lines GROUP BY doc_id""")
def f10(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.count_if(text.is_scene_break(F.col("line"))).alias("n_breaks"), F.count_if(text.is_toc_line(F.col("line"))).alias("n_toc"))


_q = lambda p: p.replace("'", "''")


@query("F12_matter_paths", with_model("pages_in") + f"""SELECT page_id, regexp_matches(stem, '^(?:{text.MATTER_STEMS})') OR len(list_intersect(regexp_split_to_array(stem, '[^a-z0-9]+'), {text.MATTER_WORDS})) > 0 AS matter
FROM (SELECT page_id, lower(regexp_replace(string_split(path, '/')[-1], '(?i)\\.[a-z0-9]+$', '')) AS stem FROM pages_in)""")
def f12(spark, d):
    return M.pages(spark, d).select("page_id", text.is_matter_path(F.col("path")).alias("matter"))


#: What is put before lines, by their position, so that they are headings of all classes.
_HEADS = ["Chapter One ", "", "Contents ", "  prologue: ", "Notes ", "About the author ", "chapters ", "INDEX "]


@query("F13_heading_classes", f"""WITH {LINES.replace("parts[i] AS line", f"{_HEADS}[(i - 1) % 8 + 1] || parts[i] AS line")} SELECT * FROM (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '(?i){_q(text.FRONT_HEADINGS)}') THEN 'front' WHEN regexp_matches(line, '(?i){_q(text.BACK_HEADINGS)}') THEN 'back'
WHEN regexp_matches(line, '(?i){text.START_HEADINGS}') THEN 'start' END AS heading_class FROM lines) WHERE heading_class IS NOT NULL""")
def f13(spark, d):
    headed = F.concat(F.element_at(F.lit(_HEADS), (F.col("pos") % 8 + 1).cast("int")), "line")
    return lines(spark, d).select("doc_id", "pos", text.heading_class(headed).alias("heading_class")).where("heading_class IS NOT NULL")


@query("F23_durations", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ms < 0 THEN '--:--' ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS short,
CASE WHEN ms < 0 THEN '--:--' WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS long
FROM (SELECT *, CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS s FROM (SELECT *, CAST(l_extendedprice * 100 AS BIGINT) - 100000 AS ms FROM lineitem))""")
def f23(spark, d):
    ms = (F.round(F.col("l_extendedprice") * 100).cast("long") - 100000)
    return M.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", formats.duration(ms).alias("short"), formats.duration(ms, hours=True).alias("long"))


@query("F24_hashes", "SELECT doc_id, md5(text) AS source_hash, sha256(text) AS token_hash, md5(text) = md5(trim(text)) AS matches FROM documents")
def f24(spark, d):
    t = F.col("text").cast("binary")
    return M.table(spark, d, "documents").select("doc_id", F.md5(t).alias("source_hash"), F.sha2(t, 256).alias("token_hash"), (F.md5(t) == F.md5(F.trim("text").cast("binary"))).alias("matches"))


@query("F25_text_hygiene", """SELECT page_id, lower(trim(' ' || host || '@Mail.Org ')) AS email, CASE WHEN ends_with(lower(base), '.epub') THEN base ELSE 'uploaded.epub' END AS file_name, regexp_replace(host || chr(9) || base, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS log_safe
FROM (SELECT page_id, book_id AS host, string_split(regexp_replace(path || CASE WHEN page_id % 2 = 0 THEN '.EPUB' ELSE '' END, '/+$', ''), '/')[-1] AS base FROM pages_in)""".replace("SELECT page_id, lower", with_model("pages_in") + "SELECT page_id, lower", 1))
def f25(spark, d):
    p = M.pages(spark, d).withColumn("path", F.concat("path", F.when(F.col("page_id") % 2 == 0, ".EPUB").otherwise("")))
    base = F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1)
    return p.select("page_id", text.clean_email(F.concat(F.lit(" "), "book_id", F.lit("@Mail.Org "))).alias("email"), text.safe_file_name(F.col("path")).alias("file_name"), text.without_controls(F.concat("book_id", F.lit("\t"), base)).alias("log_safe"))


@query("F26_storage_keys", with_model("chapters", "segments") + "SELECT 'books/' || book_id || '/chapters/' || chapter_id || '/' || segment_index || '.wav' AS key, CAST(book_id AS VARCHAR) AS owner FROM segments JOIN chapters USING (chapter_id)")
def f26(spark, d):
    s = M.segments(spark, d).join(M.chapters(spark, d).select("chapter_id", "book_id"), "chapter_id")
    key = formats.storage_key(F.col("book_id"), F.col("chapter_id"), F.col("segment_index"))
    return s.select(key.alias("key")).withColumn("owner", formats.book_of_key(F.col("key")))


_MESSAGE = "event_type || CASE event_id % 5 WHEN 0 THEN ' torrent gone' WHEN 1 THEN ' spine broken' WHEN 2 THEN ' too short' ELSE ' ' || props END"


@query("F27_failure_reasons", f"""SELECT event_id, CASE WHEN regexp_matches(m, '(?i)torrent|torbox') THEN 'download' WHEN regexp_matches(m, '(?i)epub|parse|spine') THEN 'parse' WHEN regexp_matches(m, '(?i)too short|word count') THEN m ELSE 'unexpected' END AS reason
FROM (SELECT event_id, {_MESSAGE} AS m FROM events)""")
def f27(spark, d):
    return M.table(spark, d, "events").select("event_id", formats.failure_reason(F.expr(_MESSAGE.replace("CASE event_id % 5", "CASE cast(event_id % 5 as int)"))).alias("reason"))


@query("F28_retryable", "SELECT event_id, NOT (event_id % 7 = 0) AND (s IS NULL OR s IN (408, 409, 425, 429) OR s >= 500) AS retryable FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 400 + event_id % 120 END AS s FROM events)")
def f28(spark, d):
    i = F.col("event_id")
    return M.table(spark, d, "events").select(i, formats.is_retryable(F.when(i % 11 != 0, 400 + i % 120), i % 7 == 0).alias("retryable"))


#: Documents as chapters, packed.
_PACKED = f"""WITH RECURSIVE {LINES}, blocks AS (SELECT doc_id AS ch, pos AS b, CASE WHEN {DIALOGUE} THEN 'dialogue' ELSE 'narration' END AS kind, line FROM lines), {packing_sql.segments("blocks")}
"""


@query("F9_oversized_units", f"""WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), {packing_sql.units("docs", "doc_id")}
SELECT doc_id, count(*) AS n_units, CAST(max({WORDS.format("piece")}) AS BIGINT) AS largest, md5(string_agg(piece, chr(10) ORDER BY u)) AS units_md5 FROM docs_unit GROUP BY doc_id""")
def f9(spark, d):
    return packing.oversized_units(M.spread(M.table(spark, d, "documents").select("doc_id", "text")))


@query("WN17_segment_packing", _PACKED + "SELECT source AS book_id, ch AS chapter_id, segment_index, CAST(n_words AS INTEGER) AS n_words, is_scene_break, md5(raw_text) AS text_md5 FROM seg JOIN documents ON doc_id = ch")
def wn17(spark, d):
    return packing.segments(chapter_blocks(spark, d)).select("book_id", "chapter_id", "segment_index", "n_words", "is_scene_break", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


@query("WN17_segment_summary", _PACKED + "SELECT source AS book_id, ch AS chapter_id, count(*) AS n_segments, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(max(n_words) AS INTEGER) AS largest, count(*) FILTER (n_words > 250) AS over_budget FROM seg JOIN documents ON doc_id = ch GROUP BY ALL")
def wn17_summary(spark, d):
    s = packing.segments(chapter_blocks(spark, d))
    return s.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n_segments"), F.sum("n_words").alias("n_words"), F.max("n_words").alias("largest"), F.count_if(F.col("n_words") > 250).alias("over_budget"))


@query("SS2_structured_book", _PACKED + """SELECT source AS book_id, doc_id AS chapter_id, CAST(NULL AS INTEGER) AS segment_index, count(ch) AS total_count, CASE WHEN count(ch) = 0 THEN 'failed' ELSE 'queued' END AS status, CAST(NULL AS VARCHAR) AS text_md5 FROM documents LEFT JOIN seg ON ch = doc_id GROUP BY ALL
UNION ALL SELECT source, ch, segment_index, NULL, 'pending', md5(raw_text) FROM seg JOIN documents ON doc_id = ch""")
def ss2(spark, d):
    """Chapter rows and segment rows, one below the other."""
    blocks = chapter_blocks(spark, d)
    packed = packing.segments(blocks).select("book_id", "chapter_id", "segment_index", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))
    chapters, segments = packing.structured_book(blocks, Steps(spark).keep(packed))  # packed once, for the counts and the rows
    return chapters.unionByName(segments, allowMissingColumns=True)


@query("SS3_upsert", with_model("playback") + """SELECT book_id, event_id, ts, position_ms FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, fresh DESC, event_id DESC) AS place
FROM (SELECT *, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END AS fresh FROM playback)) WHERE place = 1""")
def ss3(spark, d):
    p = M.playback(spark, d)
    return sinks.upsert(p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1"), ["book_id"], "ts", "event_id")


@query("SS4_insert_if_absent", with_model("books") + """, old AS (SELECT book_id, 'narrator' AS name FROM books WHERE status = 'ready'), new AS (SELECT book_id, 'Narrator' AS name FROM books)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE book_id NOT IN (SELECT book_id FROM old)""")
def ss4(spark, d):
    b = M.books(spark, d)
    return sinks.insert_if_absent(b.where("status = 'ready'").select("book_id", F.lit("narrator").alias("name")), b.select("book_id", F.lit("Narrator").alias("name")), ["book_id"])


@query("SS6_json_column", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def ss6(spark, d):
    return M.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SS1_page_source", with_model("pages_in") + "SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY spine_index) AS INTEGER) AS spine_index, page_id, path FROM pages_in WHERE page_id % 7 <> 3")
def ss1(spark, d):
    marked = M.pages(spark, d).withColumn("linear", F.when(F.col("page_id") % 7 == 3, "no").when(F.col("page_id") % 2 == 0, "yes"))
    return sinks.reading_order(marked).select("book_id", "spine_index", "page_id", "path")


@query("AG10_exact_duplicates", "SELECT doc_id, md5(text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS place FROM documents) WHERE place = 1")
def ag10(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return sinks.first_of_each(docs, ["hash"], "doc_id")


@query("JN12_submissions", """WITH b AS (SELECT doc_id AS book_id, lang AS user_id, md5(text) AS source_hash, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'ready' WHEN 2 THEN 'failed' ELSE 'in_progress' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'k' END AS file_key FROM documents WHERE doc_id % 3 <> 0),
o AS (SELECT user_id, source_hash, min(book_id) AS book_id, arg_min(status, book_id) AS status, bool_or(book_id % 4 = 0 AND book_id = m) AS has_file FROM (SELECT *, min(book_id) OVER (PARTITION BY user_id, source_hash) AS m FROM b) GROUP BY ALL)
SELECT d.doc_id, o.book_id, CASE WHEN o.book_id IS NULL THEN 'new' WHEN status = 'failed' AND has_file THEN 'retryable' WHEN status = 'failed' THEN 'conflict' ELSE 'existing' END AS kind
FROM documents d LEFT JOIN o ON d.lang = o.user_id AND md5(d.text) = o.source_hash""")
def jn12(spark, d):
    docs = M.table(spark, d, "documents").select("doc_id", F.col("lang").alias("user_id"), F.md5(F.col("text").cast("binary")).alias("source_hash"))
    i = F.col("doc_id")
    books = docs.where(i % 3 != 0).select(i.alias("book_id"), "user_id", "source_hash", F.when(i % 4 == 1, "ready").when(i % 4 == 3, "in_progress").otherwise("failed").alias("status"), F.when(i % 4 == 0, "k").alias("file_key"))
    return O.submissions(docs, books).select("doc_id", "book_id", "kind")


@query("SO2_storage_keys", with_model("books", "chapters", "segments") + """SELECT 'books/' || book_id || '/cover' AS key FROM books WHERE status <> 'discovering' UNION ALL SELECT 'books/' || book_id || '/source' FROM books
UNION ALL SELECT 'books/' || book_id || '/chapters/' || chapter_id FROM chapters WHERE status = 'ready'
UNION ALL SELECT 'books/' || book_id || '/chapters/' || chapter_id || '/' || segment_index || '.wav' FROM segments s JOIN chapters c USING (chapter_id) WHERE s.status = 'voiced'""")
def so2(spark, d):
    return O.storage_keys(*keyed_tables(spark, d)).select("key")


def keyed_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, chapters and segments with their storage keys."""
    at = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    k = F.col("book_id")
    books = M.books(spark, d).select(k, "user_id", F.when(F.col("status") != "discovering", at("books/", k, "/cover")).alias("cover_key"), at("books/", k, "/source").alias("file_key"))
    chapters = M.chapters(spark, d).select("chapter_id", k, F.when(F.col("status") == "ready", at("books/", k, "/chapters/", F.col("chapter_id"))).alias("audio_key"))
    voiced = M.segments(spark, d).where("status = 'voiced'").join(chapters.select("chapter_id", "book_id"), "chapter_id")
    return books, chapters, voiced.select("chapter_id", formats.storage_key(k, F.col("chapter_id"), F.col("segment_index")).alias("audio_key"))
