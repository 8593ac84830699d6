"""Ordered-sequence operators: contexts, look-ahead, timelines, positions. Sums along a chapter run in parts (``scan``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import scan
from quillspark.operators.status import DEFAULT_SUMMARY, TERMINAL

#: Gaps between segments. Fixed values.
GAP_MS, SCENE_GAP_MS = 350, 700
#: Groups that a book's segments are dealt to before its first few are taken.
DEALS = 32


def _chapter() -> Window:
    return Window.partitionBy("chapter_id").orderBy("segment_index")


def previous_texts(segments: DataFrame, n: int = 2) -> DataFrame:
    """WN5: the texts of the n segments before each, in reading order."""
    return segments.select("chapter_id", "segment_index", F.collect_list("raw_text").over(_chapter().rowsBetween(-n, -1)).alias("context"))


def running_summary(segments: DataFrame) -> DataFrame:
    """WN6: the nearest earlier summary."""
    last = F.last("scene_summary", ignorenulls=True).over(_chapter().rowsBetween(Window.unboundedPreceding, -1))
    return segments.select("chapter_id", "segment_index", F.coalesce(last, F.lit(DEFAULT_SUMMARY)).alias("summary"))


def lookahead(segments: DataFrame, chapters: DataFrame, anchors: DataFrame, k: int = 4) -> DataFrame:
    """WN7: of the first k open segments at or after each book's anchor (chapter_index, segment_index), the pending ones."""
    at = anchors.select("book_id", F.struct(F.col("chapter_index").alias("c"), F.col("segment_index").alias("s")).alias("anchor")).hint("merge")  # a row a book: sorted, not sent to all
    c = chapters.select("chapter_id", "book_id", "chapter_index").withColumn("deal", F.pmod(F.xxhash64("chapter_id"), F.lit(DEALS))).join(at, "book_id")
    here = F.struct(F.col("chapter_index").alias("c"), F.col("segment_index").alias("s"))
    s = segments.where(~F.col("status").isin(*TERMINAL)).select("chapter_id", "segment_index", "status").join(c, "chapter_id").where(here >= F.col("anchor"))
    for by in (["book_id", "deal"], ["book_id"]):  # the first few of each deal, then of the book
        s = s.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("chapter_index", "segment_index"))).where(F.col("place") <= k)
    return s.where(F.col("status") == "pending").select("book_id", "chapter_id", "segment_index", "place")


def chapter_lookahead(segments: DataFrame, chapters: DataFrame, listeners: DataFrame) -> DataFrame:
    """WN8: pending segments of each listener's chapter and the next."""
    at = listeners.select("book_id", F.explode(F.array(F.col("chapter_index"), F.col("chapter_index") + 1)).alias("chapter_index")).distinct()
    c = chapters.join(at, ["book_id", "chapter_index"]).select("chapter_id", "book_id", "chapter_index")
    return segments.where(F.col("status") == "pending").join(c, "chapter_id").select("book_id", "chapter_index", "chapter_id", "segment_index")


def prefetch(segments: DataFrame, chapters: DataFrame, listeners: DataFrame) -> DataFrame:
    """WN9: queued segments of the next chapter, if the listener's chapter has no open work."""
    c = chapters.select("chapter_id", "book_id", "chapter_index")
    busy = segments.where(F.col("status").isin("queued", "processing", "annotated")).join(c, "chapter_id").select("book_id", "chapter_index").distinct()
    free = listeners.join(busy, ["book_id", "chapter_index"], "left_anti").select("book_id", (F.col("chapter_index") + 1).alias("chapter_index"))
    return segments.where(F.col("status") == "queued").join(c.join(free, ["book_id", "chapter_index"]), "chapter_id").select("book_id", "chapter_index", "chapter_id", "segment_index")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """WN10: the last row of each key by ``order``; the last order column breaks ties."""
    by = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("place", F.row_number().over(by)).where("place = 1").drop("place")


def timeline(segments: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """WN11: start of every voiced segment in its chapter's audio; a longer gap follows a scene break."""
    v = segments.where((F.col("status") == "voiced") & F.col("duration_ms").isNotNull())
    v = v.select("chapter_id", "segment_index", "duration_ms", F.when(F.col("is_scene_break"), SCENE_GAP_MS).when(~F.col("is_scene_break"), GAP_MS).otherwise(0).alias("then"))
    step = F.col("duration_ms") + F.col("then")
    v = scan.running(v, "chapter_id", "segment_index", width, gap_ms=scan.latest(F.col("then")), start_ms=scan.before(step), _all=scan.whole(step), _last=scan.final(F.col("then")))
    return v.select("chapter_id", "segment_index", F.coalesce("gap_ms", F.lit(0)).alias("gap_ms"), "start_ms", (F.col("_all") - F.col("_last")).alias("chapter_ms"))


def _placed(segments: DataFrame, width: int) -> DataFrame:
    s = segments.select("chapter_id", "segment_index", F.coalesce("duration_ms", F.lit(0)).alias("d"), (F.col("status") == "voiced").alias("ok"))
    return scan.running(s, "chapter_id", "segment_index", width, end=scan.total(F.col("d")), all=scan.whole(F.col("d")))


def resume_at(segments: DataFrame, positions: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """WN12: the segment where each chapter's saved position resumes: the first that plays at or behind the position, else the first that plays."""
    s = _placed(segments, width).join(positions.select("chapter_id", "position_ms"), "chapter_id")
    land = s.groupBy("chapter_id", "position_ms").agg(
        F.min(F.when((F.col("d") > 0) & (F.col("end") > F.col("position_ms")), F.col("segment_index"))).alias("hit"),
        F.max("segment_index").alias("last"), F.min(F.when(F.col("ok"), F.col("segment_index"))).alias("first"))
    land = land.withColumn("land", F.when(F.col("position_ms") <= 0, F.lit(0)).otherwise(F.coalesce("hit", "last")))
    plays = segments.where(F.col("status") == "voiced").select("chapter_id", F.col("segment_index").alias("plays")).join(land.select("chapter_id", "position_ms", "land"), "chapter_id")
    next_ = plays.where(F.col("plays") >= F.col("land")).groupBy("chapter_id", "position_ms").agg(F.min("plays").alias("next"))
    return land.join(next_, ["chapter_id", "position_ms"], "left").select("chapter_id", "position_ms", F.coalesce("next", "first").alias("segment_index"))


def seek(segments: DataFrame, ratios: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """WN13: the segment and the offset in it at a share of each chapter."""
    s = _placed(segments, width).join(ratios, "chapter_id").withColumn("target", F.col("ratio") * F.col("all"))
    index, start = F.col("segment_index"), F.col("end") - F.col("d")
    hit = F.when((F.col("d") > 0) & (F.col("end") >= F.col("target")), index)
    agg = s.groupBy("chapter_id", "target").agg(  # numbers, not structs: these are aggregated without sorting the segments
        F.min(hit).alias("hit"), F.min_by(start, hit).alias("hit_start"), F.max(index).alias("last"), F.max_by(start, index).alias("last_start"))
    return agg.select("chapter_id", F.coalesce("hit", "last").alias("segment_index"), F.greatest(F.lit(0.0), F.col("target") - F.coalesce("hit_start", "last_start")).alias("offset_ms"))


def neighbours(segments: DataFrame) -> DataFrame:
    """WN14: the next and the previous segment that hasn't failed."""
    by, ok = _chapter(), F.when(F.col("status") != "failed", F.col("segment_index"))
    return segments.select(
        "chapter_id", "segment_index", F.first(ok, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("next_index"),
        F.last(ok, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_index"))


def auto_advance(counted: DataFrame) -> DataFrame:
    """WN15: the next later chapter with something to hear."""
    ok = F.when((F.col("voiced") > 0) & F.col("status").isin("ready", "partial_ready", "processing"), F.col("chapter_index"))
    by = Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(1, Window.unboundedFollowing)
    return counted.select("book_id", "chapter_id", "chapter_index", F.first(ok, ignorenulls=True).over(by).alias("next_chapter"))


def live_chapter(counted: DataFrame) -> DataFrame:
    """WN16: a book's chapter to listen to now: partly ready, else ready, else under way with something done."""
    rank = F.when(F.col("status") == "partial_ready", 1).when(F.col("status") == "ready", 2).when(F.col("status").isin("processing", "queued") & (F.col("voiced") + F.col("failed") > 0), 3)
    c = counted.withColumn("rank", rank).where("rank IS NOT NULL")
    by = Window.partitionBy("book_id").orderBy("rank", "chapter_index")
    return c.withColumn("place", F.row_number().over(by)).where("place = 1").select("book_id", "chapter_id", "chapter_index", "rank")


def recent(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """WN18: the n last rows of each key, newest first."""
    by = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)


def played(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """AG6: chapter length, and the shares buffered and played (at most 100)."""
    s = segments.groupBy("chapter_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_ms"), F.count_if(F.col("status") == "voiced").alias("voiced"), F.count("*").alias("n"))
    share = F.when(F.col("total_ms") > 0, F.least(F.lit(100.0), F.col("position_ms") * 100.0 / F.col("total_ms"))).otherwise(0.0)
    return s.join(positions, "chapter_id").select("chapter_id", "total_ms", (F.col("voiced") * 100.0 / F.col("n")).alias("buffered_pct"), share.alias("played_pct"))


def work_order(queued: DataFrame, limit: int = 2000) -> DataFrame:
    """TK4: the first queued segments in reading order, priority by chapter."""
    return queued.orderBy("book_id", "chapter_index", "segment_index").limit(limit).select("book_id", "chapter_index", "segment_index", F.col("chapter_index").alias("priority"))
