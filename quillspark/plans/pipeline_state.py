"""Queries of pipeline state and ordered sequences, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import sequence as S
from quillspark.operators import status as O
from quillspark.plans.registry import query
from quillspark.sources import model as M
from quillspark.sources.model import with_model

COUNTED = """counted AS (SELECT c.*, coalesce(n.total, 0) AS total, coalesce(n.voiced, 0) AS voiced, coalesce(n.failed, 0) AS failed FROM chapters c LEFT JOIN (
  SELECT chapter_id, count(*) AS total, count(*) FILTER (status = 'voiced') AS voiced, count(*) FILTER (status = 'failed') AS failed FROM segments GROUP BY chapter_id) n USING (chapter_id))"""
CHAPTERS = with_model("chapters", "segments") + ", " + COUNTED
POSITIONS = "positions AS (SELECT o_orderkey AS chapter_id, CAST(o_orderkey % 9000 AS INTEGER) AS position_ms FROM orders)"
LISTENERS = "listeners AS (SELECT c_custkey AS book_id, CAST(c_custkey % 5 + 1 AS INTEGER) AS chapter_index, CAST(c_custkey % 3 + 1 AS INTEGER) AS segment_index FROM customer)"


def positions(spark, d):
    return M.table(spark, d, "orders").select(F.col("o_orderkey").alias("chapter_id"), (F.col("o_orderkey") % 9000).cast("int").alias("position_ms"))


def listeners(spark, d):
    k = F.col("c_custkey")
    return M.table(spark, d, "customer").select(k.alias("book_id"), (k % 5 + 1).cast("int").alias("chapter_index"), (k % 3 + 1).cast("int").alias("segment_index"))


def counted(spark, d):
    return O.counters_of_all(M.chapters(spark, d), M.segments(spark, d))


@query("AG1_chapter_counters", with_model("segments") + "SELECT chapter_id, count(*) AS total, count(*) FILTER (status = 'voiced') AS voiced, count(*) FILTER (status = 'failed') AS failed FROM segments GROUP BY chapter_id")
def ag1(spark, d):
    return O.counters(M.segments(spark, d))


@query("AG2_book_completion", with_model("books", "chapters") + """SELECT b.book_id, b.status AS old_status, CASE WHEN n = ended AND ready > 0 THEN 'ready' WHEN n = ended THEN 'failed' ELSE b.status END AS new_status
FROM books b LEFT JOIN (SELECT book_id, count(*) AS n, count(*) FILTER (status IN ('ready', 'failed')) AS ended, count(*) FILTER (status = 'ready') AS ready FROM chapters GROUP BY book_id) USING (book_id)""")
def ag2(spark, d):
    return O.book_completion(M.books(spark, d), M.chapters(spark, d))


@query("AG3_book_progress", CHAPTERS + """SELECT book_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(voiced + failed) AS BIGINT) AS done,
CAST(CASE WHEN sum(total) > 0 THEN round(sum(voiced + failed) * 100 / sum(total)) ELSE 0 END AS INTEGER) AS percent, count(*) FILTER (status = 'ready') AS ready, count(*) AS chapters FROM counted GROUP BY book_id""")
def ag3(spark, d):
    return O.book_progress(M.chapters(spark, d), M.segments(spark, d))


@query("AG5_size_caps", CHAPTERS + """, held AS (SELECT chapter_id, sum(strlen(raw_text)) AS n_bytes FROM segments GROUP BY chapter_id)
SELECT book_id, count(*) AS n_chapters, CAST(sum(total) AS BIGINT) AS n_segments, max(total) AS largest_chapter, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS n_bytes,
CASE WHEN coalesce(sum(n_bytes), 0) > 700 THEN 'too much text' WHEN count(*) > 20 THEN 'too many chapters' WHEN max(total) > 9 THEN 'too many segments in a chapter' WHEN sum(total) > 60 THEN 'too many segments' END AS reason FROM counted LEFT JOIN held USING (chapter_id) GROUP BY book_id""")
def ag5(spark, d):
    return O.size_caps(M.chapters(spark, d), M.segments(spark, d), per_chapter=9, per_book=60, chapters_per_book=20, bytes_per_book=700)


@query("AG6_played_share", with_model("segments") + ", " + POSITIONS + """SELECT s.chapter_id, CAST(total_ms AS BIGINT) AS total_ms, voiced * 100.0::DOUBLE / n AS buffered_pct,
CASE WHEN total_ms > 0 THEN least(100.0::DOUBLE, position_ms * 100.0::DOUBLE / total_ms) ELSE 0.0 END AS played_pct
FROM (SELECT chapter_id, sum(coalesce(duration_ms, 0)) AS total_ms, count(*) FILTER (status = 'voiced') AS voiced, count(*) AS n FROM segments GROUP BY chapter_id) s JOIN positions USING (chapter_id)""")
def ag6(spark, d):
    return S.played(M.segments(spark, d), positions(spark, d))


@query("AG7_partial_ready", with_model("segments") + """SELECT chapter_id, coalesce(bool_and(status IN ('voiced', 'failed')) FILTER (segment_index <= 1) AND bool_or(status = 'voiced') FILTER (segment_index <= 1), false) AS partial_ready FROM segments GROUP BY chapter_id""")
def ag7(spark, d):
    return O.partial_ready(M.segments(spark, d))


@query("AG8_chapter_terminal", CHAPTERS + "SELECT chapter_id, total, CASE WHEN total = 0 THEN 'failed' WHEN voiced + failed < total THEN 'unchanged' WHEN voiced = 0 THEN 'failed' ELSE 'stitch' END AS outcome FROM counted")
def ag8(spark, d):
    return O.chapter_terminal(M.chapters(spark, d), M.segments(spark, d))


@query("AG9_due_for_stitch", CHAPTERS + "SELECT chapter_id, book_id, chapter_index FROM counted WHERE status IN ('queued', 'processing', 'partial_ready') AND voiced + failed >= total")
def ag9(spark, d):
    return O.due_for_stitch(M.chapters(spark, d), M.segments(spark, d))


@query("AG12_queue_depth", with_model("segments") + "SELECT job_state, count(*) AS n, coalesce(sum(count(*) FILTER (job_state = 'waiting')) OVER (), 0) < 100 AS refill FROM segments WHERE job_state IS NOT NULL GROUP BY job_state")
def ag12(spark, d):
    return O.queue_depth(M.segments(spark, d))


@query("JN1_queued_work", with_model("books", "chapters", "segments") + "SELECT book_id, chapter_id, chapter_index, segment_index FROM segments s JOIN chapters c USING (chapter_id) JOIN books b USING (book_id) WHERE s.status = 'queued' AND b.status = 'in_progress'")
def jn1(spark, d):
    return O.queued_work(M.books(spark, d), M.chapters(spark, d), M.segments(spark, d))


@query("JN2_owned_chapters", with_model("books", "chapters") + "SELECT * FROM chapters WHERE book_id IN (SELECT book_id FROM books WHERE user_id = 7)")
def jn2(spark, d):
    return O.owned(M.chapters(spark, d), M.books(spark, d), 7)


@query("JN5_zero_counters", CHAPTERS + "SELECT chapter_id, book_id, chapter_index, status, total, voiced, failed FROM counted")
def jn5(spark, d):
    return counted(spark, d).select("chapter_id", "book_id", "chapter_index", "status", "total", "voiced", "failed")


@query("JN6_orphans", with_model("segments") + """SELECT chapter_id, segment_index, attempts + CASE WHEN job_state = 'failed' THEN 1 ELSE 0 END AS effective_attempts,
CASE WHEN attempts + CASE WHEN job_state = 'failed' THEN 1 ELSE 0 END >= 5 THEN 'failed' ELSE 'queued' END AS new_status
FROM segments WHERE status IN ('processing', 'annotated') AND NOT coalesce(job_state IN ('active', 'waiting'), false)""")
def jn6(spark, d):
    s = M.segments(spark, d)
    jobs = s.where("job_state IS NOT NULL").select("chapter_id", "segment_index", F.col("job_state").alias("state"))
    return O.orphans(s.drop("job_state"), jobs)


@query("JN7_lineage_errors", with_model("chapters", "segments") + """SELECT s.chapter_id, segment_index, s.book_id, c.book_id AS true_book FROM (
SELECT chapter_id, segment_index, chapter_id % 997 AS book_id FROM segments WHERE job_state IS NOT NULL) s LEFT JOIN chapters c USING (chapter_id) WHERE c.book_id IS DISTINCT FROM s.book_id""")
def jn7(spark, d):
    jobs = M.segments(spark, d).where("job_state IS NOT NULL").select("chapter_id", "segment_index", (F.col("chapter_id") % 997).alias("book_id"))
    return O.lineage_errors(jobs, M.chapters(spark, d))


@query("JN10_cascade_delete", with_model("books", "chapters", "segments") + """, gone AS (SELECT book_id FROM books WHERE status = 'failed')
SELECT 'books' AS kind, count(*) AS n FROM books WHERE book_id NOT IN (SELECT book_id FROM gone)
UNION ALL SELECT 'chapters', count(*) FROM chapters WHERE book_id NOT IN (SELECT book_id FROM gone)
UNION ALL SELECT 'segments', count(*) FROM segments WHERE chapter_id NOT IN (SELECT chapter_id FROM chapters WHERE book_id IN (SELECT book_id FROM gone))""")
def jn10(spark, d):
    books = M.books(spark, d)
    left = O.removed_books(books, M.chapters(spark, d), M.segments(spark, d), books.where("status = 'failed'"))
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in zip(("books", "chapters", "segments"), left)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("PF1_owner_rows", with_model("books") + "SELECT book_id, title, status FROM books WHERE user_id = 7 ORDER BY book_id")
def pf1(spark, d):
    return M.books(spark, d).where(F.col("user_id") == 7).select("book_id", "title", "status").orderBy("book_id")


@query("PF2_segment_flags", with_model("segments") + "SELECT chapter_id, segment_index, status IN ('pending', 'queued', 'processing', 'annotated') AS pending, status = 'voiced' AND duration_ms IS NOT NULL AS playable FROM segments")
def pf2(spark, d):
    s = M.segments(spark, d)
    return s.select("chapter_id", "segment_index", O.is_pending(F.col("status")).alias("pending"), O.is_playable(F.col("status"), F.col("duration_ms").isNotNull()).alias("playable"))


@query("PF3_active_users", with_model("books") + "SELECT user_id, bool_or(status IN ('discovering', 'casting', 'in_progress')) AS active FROM books GROUP BY user_id")
def pf3(spark, d):
    return O.active_users(M.books(spark, d))


@query("PF5_chapter_playable", CHAPTERS + "SELECT chapter_id, status IN ('ready', 'partial_ready') OR (voiced + failed > 0 AND status IN ('processing', 'queued')) AS playable FROM counted")
def pf5(spark, d):
    return O.chapter_playable(counted(spark, d))


@query("WN5_previous_texts", with_model("segments") + "SELECT chapter_id, segment_index, coalesce(list(raw_text) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS context FROM segments")
def wn5(spark, d):
    return S.previous_texts(M.segments(spark, d))


@query("WN6_running_summary", with_model("segments") + "SELECT chapter_id, segment_index, coalesce(last_value(scene_summary IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'A scene in the book.') AS summary FROM segments")
def wn6(spark, d):
    return S.running_summary(M.segments(spark, d))


@query("WN7_lookahead", with_model("chapters", "segments") + ", " + LISTENERS + """SELECT book_id, chapter_id, segment_index, CAST(place AS INTEGER) AS place FROM (
SELECT c.book_id, s.chapter_id, s.segment_index, s.status, row_number() OVER (PARTITION BY c.book_id ORDER BY c.chapter_index, s.segment_index) AS place
FROM segments s JOIN chapters c USING (chapter_id) JOIN listeners l ON l.book_id = c.book_id
WHERE s.status NOT IN ('voiced', 'failed') AND (c.chapter_index > l.chapter_index OR c.chapter_index = l.chapter_index AND s.segment_index >= l.segment_index)) WHERE place <= 4 AND status = 'pending'""")
def wn7(spark, d):
    return S.lookahead(M.segments(spark, d), M.chapters(spark, d), listeners(spark, d))


@query("WN8_chapter_lookahead", with_model("chapters", "segments") + ", " + LISTENERS + """SELECT c.book_id, c.chapter_index, s.chapter_id, s.segment_index FROM segments s JOIN chapters c USING (chapter_id) JOIN listeners l
ON l.book_id = c.book_id AND c.chapter_index IN (l.chapter_index, l.chapter_index + 1) WHERE s.status = 'pending'""")
def wn8(spark, d):
    return S.chapter_lookahead(M.segments(spark, d), M.chapters(spark, d), listeners(spark, d))


@query("WN9_prefetch", with_model("chapters", "segments") + ", " + LISTENERS + """SELECT c.book_id, c.chapter_index, s.chapter_id, s.segment_index FROM segments s JOIN chapters c USING (chapter_id) JOIN listeners l
ON l.book_id = c.book_id AND c.chapter_index = l.chapter_index + 1 WHERE s.status = 'queued' AND NOT EXISTS (
SELECT 1 FROM segments s2 JOIN chapters c2 USING (chapter_id) WHERE c2.book_id = l.book_id AND c2.chapter_index = l.chapter_index AND s2.status IN ('queued', 'processing', 'annotated'))""")
def wn9(spark, d):
    return S.prefetch(M.segments(spark, d), M.chapters(spark, d), listeners(spark, d))


@query("WN10_latest_playback", with_model("playback") + "SELECT book_id, event_id, ts, position_ms FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, event_id DESC) AS place FROM playback) WHERE place = 1")
def wn10(spark, d):
    return S.latest(M.playback(spark, d), "book_id", "ts", "event_id")


@query("WN11_stitch_timeline", with_model("segments") + """, v AS (SELECT *, CASE WHEN lag(is_scene_break) OVER w IS NULL THEN 0 WHEN lag(is_scene_break) OVER w THEN 700 ELSE 350 END AS gap_ms
FROM segments WHERE status = 'voiced' AND duration_ms IS NOT NULL WINDOW w AS (PARTITION BY chapter_id ORDER BY segment_index))
SELECT chapter_id, segment_index, gap_ms, CAST(sum(gap_ms + duration_ms) OVER (PARTITION BY chapter_id ORDER BY segment_index) - duration_ms AS BIGINT) AS start_ms,
CAST(sum(gap_ms + duration_ms) OVER (PARTITION BY chapter_id) AS BIGINT) AS chapter_ms FROM v""")
def wn11(spark, d):
    return S.timeline(M.segments(spark, d))


PLACED = """placed AS (SELECT chapter_id, segment_index, coalesce(duration_ms, 0) AS d, status = 'voiced' AS ok, sum(coalesce(duration_ms, 0)) OVER (PARTITION BY chapter_id ORDER BY segment_index) AS ends,
sum(coalesce(duration_ms, 0)) OVER (PARTITION BY chapter_id) AS alls FROM segments)"""


@query("WN12_resume_position", with_model("segments") + ", " + PLACED + ", " + POSITIONS + """, land AS (
SELECT chapter_id, position_ms, CASE WHEN position_ms <= 0 THEN 0 ELSE coalesce(min(segment_index) FILTER (d > 0 AND ends > position_ms), max(segment_index)) END AS land, min(segment_index) FILTER (ok) AS first_ok
FROM placed JOIN positions USING (chapter_id) GROUP BY chapter_id, position_ms)
SELECT l.chapter_id, position_ms, coalesce((SELECT min(segment_index) FROM placed p WHERE p.chapter_id = l.chapter_id AND ok AND p.segment_index >= l.land), first_ok) AS segment_index FROM land l""")
def wn12(spark, d):
    return S.resume_at(M.segments(spark, d), positions(spark, d))


@query("WN13_seek", with_model("segments") + ", " + PLACED + """, t AS (SELECT *, (chapter_id % 10) / 10.0::DOUBLE * alls AS target FROM placed),
hit AS (SELECT chapter_id, target, coalesce(min(segment_index) FILTER (d > 0 AND ends >= target), max(segment_index)) AS segment_index FROM t GROUP BY chapter_id, target)
SELECT h.chapter_id, h.segment_index, greatest(0.0::DOUBLE, h.target - (t.ends - t.d)) AS offset_ms FROM hit h JOIN t USING (chapter_id, segment_index)""")
def wn13(spark, d):
    o = M.table(spark, d, "orders")
    return S.seek(M.segments(spark, d), o.select(F.col("o_orderkey").alias("chapter_id"), (F.col("o_orderkey") % 10 / F.lit(10.0)).alias("ratio")))


@query("WN14_neighbours", with_model("segments") + """SELECT chapter_id, segment_index,
first_value(CASE WHEN status <> 'failed' THEN segment_index END IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_index,
last_value(CASE WHEN status <> 'failed' THEN segment_index END IGNORE NULLS) OVER (PARTITION BY chapter_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_index FROM segments""")
def wn14(spark, d):
    return S.neighbours(M.segments(spark, d))


@query("WN15_auto_advance", CHAPTERS + """SELECT book_id, chapter_id, chapter_index, first_value(CASE WHEN voiced > 0 AND status IN ('ready', 'partial_ready', 'processing') THEN chapter_index END IGNORE NULLS)
OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_chapter FROM counted""")
def wn15(spark, d):
    return S.auto_advance(counted(spark, d))


@query("WN16_live_chapter", CHAPTERS + """, r AS (SELECT *, CASE WHEN status = 'partial_ready' THEN 1 WHEN status = 'ready' THEN 2 WHEN status IN ('processing', 'queued') AND voiced + failed > 0 THEN 3 END AS rank FROM counted)
SELECT book_id, chapter_id, chapter_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY rank, chapter_index) AS place FROM r WHERE rank IS NOT NULL) WHERE place = 1""")
def wn16(spark, d):
    return S.live_chapter(counted(spark, d))


@query("WN18_recent_log", with_model("event_log") + "SELECT book_id, event_id, status, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ts DESC, event_id DESC) AS place FROM event_log) WHERE place <= 15")
def wn18(spark, d):
    return S.recent(M.event_log(spark, d), "book_id", 15, "ts", "event_id").select("book_id", "event_id", "status", "place")


@query("TK4_work_order", with_model("books", "chapters", "segments") + """SELECT book_id, chapter_index, segment_index, chapter_index AS priority FROM segments s JOIN chapters c USING (chapter_id) JOIN books b USING (book_id)
WHERE s.status = 'queued' AND b.status = 'in_progress' ORDER BY book_id, chapter_index, segment_index LIMIT 2000""")
def tk4(spark, d):
    return S.work_order(O.queued_work(M.books(spark, d), M.chapters(spark, d), M.segments(spark, d)))
