"""Queries of page structuring. The twins cut the blocks of the given pages, which are simply built, out of the HTML by text functions;
rules that need other pages are tested on literal ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import packing
from quillspark.operators import pages as P
from quillspark.plans import packing_sql
from quillspark.plans.registry import query
from quillspark.plans.text_queries import DIALOGUE, WORDS
from quillspark.sources import model as M
from quillspark.sources.model import with_model


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _toc(column: str) -> str:
    return f"(trim({column}) <> '' AND length(trim({column})) <= 120 AND (" + " OR ".join(f"regexp_matches(trim({column}), {_quoted(p)})" for p in T.TOC_LINES) + "))"


_FRONT, _BACK, _START = (_quoted(p) for p in (T.FRONT_HEADINGS, T.BACK_HEADINGS, T.START_HEADINGS))
_CLEAN = r"translate(trim(regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '\[\d+\]', '', 'g')), '“”‘’', '""' || chr(39) || chr(39))"
#: Blocks (blk) and page facts (facts) of the given pages.
_FACTS = with_model("pages_in") + rf""", parts AS (
  SELECT book_id, spine_index, string_split(replace(replace(replace(replace(string_split(html, '</article>')[1], '<p>', chr(1) || 'p'), '<h1>', chr(1) || 'h'), '</p>', chr(2)), '</h1>', chr(2)), chr(1)) AS parts FROM pages_in),
held AS (  -- an element that isn't closed in a paragraph holds all that follows, and so does the paragraph
  SELECT book_id, spine_index, n, parts[n][1] AS kind, CASE WHEN contains(parts[n], '<b>') AND NOT contains(parts[n], '</b>') THEN replace(array_to_string(list_transform(parts[n:], lambda x: substr(x, 2)), ''), chr(2), '')
  ELSE substr(string_split(parts[n], chr(2))[1], 2) END AS held FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS n FROM parts)),
raw AS (  -- of these references HTML also reads those that a cut has left without their semicolon
  SELECT * EXCLUDE held, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(held, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS whole FROM held),
cleaned AS (SELECT * EXCLUDE whole, {_CLEAN.format("whole")} AS line FROM raw),
blk AS (SELECT book_id, spine_index, n, line, CASE WHEN kind = 'h' THEN 'heading' WHEN {DIALOGUE} THEN 'dialogue' ELSE 'narration' END AS type, {WORDS.format("line")} AS words, {_toc("line")} AS toc
  FROM cleaned WHERE line <> '' AND NOT regexp_matches(line, '^\d{{1,4}}$') AND NOT regexp_matches(line, '^[.…·•\-\s]*\d{{1,4}}\s*$')),
head AS (SELECT book_id, spine_index, arg_min(trim(whole), n) FILTER (kind = 'h' AND trim(whole) <> '') AS heading, CAST(coalesce(sum({WORDS.format("whole")}) FILTER (kind = 'p'), 0) AS BIGINT) AS prose FROM raw GROUP BY ALL),
links AS (SELECT book_id, spine_index, path, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS links FROM pages_in),
linked AS (SELECT book_id, spine_index, path, len(links) AS n_links, len(list_filter(links, lambda l: {_toc("l")} OR regexp_matches(l, '(?i)chapter|part|book|prologue'))) AS chapterish,
  len(list_filter(links, lambda l: {_toc("l")} OR ({WORDS.format("l")} <= 12 AND regexp_matches(l, '(?i)chapter|part|book')))) AS listed FROM links),
counts AS (SELECT book_id, spine_index, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, sum(CAST(toc AS INTEGER) + CAST(type = 'heading' AND regexp_matches(line, '(?i)^(chapter|part|book)') AND words <= 10 AS INTEGER)) AS toc,
  count(*) FILTER (words <= 14) AS short, count(*) FILTER (words >= 40) AS long, count(*) FILTER (words <= 25) AS brief, count(*) FILTER (words >= 60) AS tall, count(*) FILTER (regexp_matches(line, '^\s*["“]')) AS quoted FROM blk GROUP BY ALL),
facts AS (SELECT book_id, spine_index, path, coalesce(heading, '') AS heading, coalesce(n, 0) AS n, coalesce(words, 0) AS words,
  coalesce(n > 0 AND (regexp_matches(heading, {_FRONT}) OR (n >= 3 AND ((toc >= 4 AND toc / n >= 0.45 AND long <= 1) OR (n >= 5 AND short / n >= 0.75 AND toc >= 3 AND long = 0) OR (toc >= 3 AND toc / n >= 0.7)))), false) AS toc_page,
  coalesce(regexp_matches(heading, {_FRONT}), false) OR coalesce(n > 0 AND ((n <= 2 AND words <= 60) OR (n >= 3 AND tall = 0 AND (brief / n >= 0.7 OR quoted / n >= 0.5))), false) AS front_body,
  coalesce(regexp_matches(heading, {_FRONT}), false) OR (n_links >= 4 AND chapterish >= 3) OR n_links >= 8 OR (n_links >= 5 AND listed >= 4 AND listed / n_links >= 0.5 AND coalesce(prose, 0) < 80) AS link_list
  FROM linked LEFT JOIN head USING (book_id, spine_index) LEFT JOIN counts USING (book_id, spine_index))
"""


@query("F1_F5_F6_page_blocks", _FACTS + "SELECT book_id, spine_index, CAST(row_number() OVER (PARTITION BY book_id, spine_index ORDER BY n) - 1 AS INTEGER) AS pos, type, words, md5(line) AS text_md5 FROM blk")
def f1(spark, d):
    # of an inner posexplode Spark infers a filter on the blocks' size, which it computes from a copy of all that makes them at each of their uses
    p = P.page_facts(M.pages(spark, d)).select("book_id", "spine_index", F.posexplode_outer("blocks").alias("pos", "b")).where("pos IS NOT NULL")
    return p.select("book_id", "spine_index", "pos", "b.type", "b.words", F.md5(F.col("b.text").cast("binary")).alias("text_md5"))


@query("F2_page_headings", _FACTS + "SELECT book_id, spine_index, heading FROM facts")
def f2(spark, d):
    return P.page_facts(M.pages(spark, d)).select("book_id", "spine_index", "heading")


@query("AG13_AG14_AG15_page_tests", _FACTS + "SELECT book_id, spine_index, toc_page, front_body, link_list, words FROM facts")
def ag13(spark, d):
    return P.page_facts(M.pages(spark, d)).select("book_id", "spine_index", "toc_page", "front_body", "link_list", "words")


_CHAPTERS = _FACTS + rf""", stems AS (SELECT *, lower(regexp_replace(string_split(path, '/')[-1], '(?i)\.[a-z0-9]+$', '')) AS stem, spine_index / count(*) OVER (PARTITION BY book_id) AS fraction FROM facts),
flags AS (SELECT *, regexp_matches(stem, '^(?:{T.MATTER_STEMS})') OR len(list_intersect(regexp_split_to_array(stem, '[^a-z0-9]+'), {T.MATTER_WORDS})) > 0 AS matter, regexp_matches(heading, {_FRONT}) AS front FROM stems),
counted AS (SELECT *, NOT (matter OR front OR link_list OR toc_page) AND n > 0 AS counted FROM flags),
before AS (SELECT *, coalesce(sum(CASE WHEN counted THEN words ELSE 0 END) OVER (PARTITION BY book_id ORDER BY spine_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before FROM counted),
latched AS (SELECT *, bool_or(NOT matter AND regexp_matches(heading, {_BACK}) AND fraction >= 0.6 AND words_before >= 500) OVER (PARTITION BY book_id ORDER BY spine_index) AS over FROM before),
likely AS (SELECT *, regexp_matches(heading, {_START}) OR regexp_matches(path, {_quoted(T.START_PATHS)}) OR (words >= 400 AND NOT front_body) AS starts FROM latched WHERE counted AND NOT over AND words > 50),
begun AS (SELECT * FROM (SELECT *, bool_or(starts) OVER (PARTITION BY book_id ORDER BY spine_index) AS begun FROM likely) WHERE begun),
long AS (SELECT * FROM (SELECT *, sum(words) OVER (PARTITION BY book_id) AS book_words FROM begun) WHERE book_words >= 500),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY spine_index) AS INTEGER) AS chapter_index FROM long)
"""


@query("WN1_WN2_WN3_WN4_chapters", _CHAPTERS + """SELECT book_id, chapter_index, CASE WHEN heading <> '' THEN heading ELSE 'Chapter ' || chapter_index END AS title, path, words, n AS n_blocks FROM numbered""")
def wn1(spark, d):
    return P.chapters(M.pages(spark, d)).select("book_id", "chapter_index", "title", "path", "words", F.size("blocks").alias("n_blocks"))


@query("E1_pages_to_segments", _CHAPTERS.replace("WITH", "WITH RECURSIVE", 1) + f""", ids AS (SELECT *, row_number() OVER (ORDER BY book_id, chapter_index) AS ch FROM numbered),
told AS (SELECT ch, blk.n AS b, type AS kind, line FROM ids JOIN blk USING (book_id, spine_index)), {packing_sql.segments("told")}
SELECT book_id, chapter_index, segment_index, CAST(n_words AS INTEGER) AS n_words, is_scene_break FROM seg JOIN ids USING (ch)""")
def e1(spark, d):
    c = P.chapters(M.pages(spark, d)).select("book_id", "chapter_index", F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"))).alias("blocks"))
    return packing.segments(c).select("book_id", "chapter_index", "segment_index", "n_words", "is_scene_break")
