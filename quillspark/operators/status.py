"""Pipeline state: counters, completion, orphans, ownership, playability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING = ("pending", "queued", "processing", "annotated")
TERMINAL = ("voiced", "failed")
MAX_ATTEMPTS = 5
DEFAULT_SUMMARY = "A scene in the book."


def is_pending(status: Column) -> Column:
    return F.coalesce(status.isin(*PENDING), F.lit(False))


def is_playable(status: Column, has_audio: Column) -> Column:
    return F.coalesce((status == "voiced") & has_audio, F.lit(False))


def counters(segments: DataFrame) -> DataFrame:
    """AG1: chapter_id, total, voiced, failed."""
    return segments.groupBy("chapter_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "voiced").alias("voiced"), F.count_if(F.col("status") == "failed").alias("failed"))


def counters_of_all(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """JN5: counters of every chapter, zero for those without segments."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "voiced", "failed")]
    return chapters.join(counters(segments), "chapter_id", "left").select(*chapters.columns, *zero)


def book_completion(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """AG2: new status: ready if all chapters are ready or failed and any is ready; failed if all failed; else unchanged."""
    done = chapters.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("ready", "failed")).alias("ended"), F.count_if(F.col("status") == "ready").alias("ready"))
    over = F.col("n") == F.col("ended")
    new = F.when(over & (F.col("ready") > 0), "ready").when(over, "failed").otherwise(F.col("status"))
    return books.join(done, "book_id", "left").select("book_id", F.col("status").alias("old_status"), new.alias("new_status"))


def book_progress(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """AG3: book_id, total, done, percent (0 without segments), ready, chapters."""
    c = counters_of_all(chapters, segments)
    total, done = F.sum("total"), F.sum(F.col("voiced") + F.col("failed"))
    return c.groupBy("book_id").agg(
        total.alias("total"), done.alias("done"), F.when(total > 0, F.round(done * 100 / total)).otherwise(0).cast("int").alias("percent"),
        F.count_if(F.col("status") == "ready").alias("ready"), F.count("*").alias("chapters"))


def size_caps(chapters: DataFrame, segments: DataFrame, per_chapter: int = 5000, per_book: int = 100_000, chapters_per_book: int = 2000, bytes_per_book: int = 256 << 20) -> DataFrame:
    """AG5: book_id with its sizes and the first reason to reject it, or null."""
    text = segments.groupBy("chapter_id").agg(F.sum(F.octet_length("raw_text")).alias("n_bytes"))
    c = counters_of_all(chapters, segments).join(text, "chapter_id", "left")
    b = c.groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum("total").alias("n_segments"), F.max("total").alias("largest_chapter"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
    reason = F.when(F.col("n_bytes") > bytes_per_book, "too much text").when(F.col("n_chapters") > chapters_per_book, "too many chapters").when(F.col("largest_chapter") > per_chapter, "too many segments in a chapter").when(F.col("n_segments") > per_book, "too many segments")
    return b.withColumn("reason", reason)


def partial_ready(segments: DataFrame, threshold: int = 1) -> DataFrame:
    """AG7: whether the leading ``threshold`` segments (all, in a shorter chapter) are terminal and any is voiced."""
    lead = F.col("segment_index") <= threshold
    return segments.groupBy("chapter_id").agg(
        F.bool_and(F.when(lead, F.col("status").isin(*TERMINAL))).alias("ended"), F.bool_or(F.when(lead, F.col("status") == "voiced")).alias("heard"),
    ).select("chapter_id", F.coalesce(F.col("ended") & F.col("heard"), F.lit(False)).alias("partial_ready"))


def chapter_terminal(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """AG8: what a stitch job makes of each chapter."""
    c = counters_of_all(chapters, segments)
    new = F.when(F.col("total") == 0, "failed").when(F.col("voiced") + F.col("failed") < F.col("total"), "unchanged").when(F.col("voiced") == 0, "failed").otherwise("stitch")
    return c.select("chapter_id", "total", new.alias("outcome"))


def due_for_stitch(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """AG9: queued, processing or partly ready chapters whose segments are all terminal."""
    c = counters_of_all(chapters, segments)
    return c.where(F.col("status").isin("queued", "processing", "partial_ready") & (F.col("voiced") + F.col("failed") >= F.col("total"))).select("chapter_id", "book_id", "chapter_index")


def queue_depth(segments: DataFrame, watermark: int = 100) -> DataFrame:
    """AG12: jobs by state, with the flag whether the waiting ones are few enough to refill."""
    waiting = F.sum(F.when(F.col("job_state") == "waiting", F.col("n"))).over(Window.partitionBy(F.lit(0)))
    by = segments.where("job_state IS NOT NULL").groupBy("job_state").agg(F.count("*").alias("n"))  # a row a state
    return by.withColumn("refill", F.coalesce(waiting, F.lit(0)) < watermark)


def queued_work(books: DataFrame, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """JN1: queued segments of books in progress."""
    c = chapters.join(books.where(F.col("status") == "in_progress").select("book_id"), "book_id").select("book_id", "chapter_id", "chapter_index")
    return segments.where(F.col("status") == "queued").join(c, "chapter_id").select("book_id", "chapter_id", "chapter_index", "segment_index")


def owned(chapters: DataFrame, books: DataFrame, user_id) -> DataFrame:
    """JN2: the chapters of one user's books."""
    return chapters.join(books.where(F.col("user_id") == user_id), "book_id", "left_semi")


def orphans(segments: DataFrame, jobs: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """JN6: processing or annotated rows without a live job (chapter_id, segment_index, state), and what becomes of them."""
    rows = segments.where(F.col("status").isin("processing", "annotated")).select("chapter_id", "segment_index", "attempts")
    rows = rows.join(jobs.select("chapter_id", "segment_index", "state"), ["chapter_id", "segment_index"], "left")
    tries = F.col("attempts") + F.when(F.col("state") == "failed", 1).otherwise(0)
    return rows.where(~F.coalesce(F.col("state").isin("active", "waiting"), F.lit(False))).select(
        "chapter_id", "segment_index", tries.alias("effective_attempts"), F.when(tries >= max_attempts, "failed").otherwise("queued").alias("new_status"))


def lineage_errors(jobs: DataFrame, chapters: DataFrame) -> DataFrame:
    """JN7: jobs whose (chapter, book) is not in the tables."""
    c = chapters.select(F.col("chapter_id"), F.col("book_id").alias("true_book"))
    return jobs.join(c, "chapter_id", "left").where(~F.col("true_book").eqNullSafe(F.col("book_id"))).select("chapter_id", "segment_index", "book_id", "true_book")


def removed_books(books: DataFrame, chapters: DataFrame, segments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JN10: what is left when ``gone`` (book_id) and all below are deleted."""
    gone = gone.select("book_id").distinct()
    below = chapters.join(gone, "book_id", "left_semi").select("chapter_id")
    return books.join(gone, "book_id", "left_anti"), chapters.join(gone, "book_id", "left_anti"), segments.join(below, "chapter_id", "left_anti")


def active_users(books: DataFrame) -> DataFrame:
    """PF3: whether a user has a book in the pipeline."""
    return books.groupBy("user_id").agg(F.bool_or(F.col("status").isin("discovering", "casting", "in_progress")).alias("active"))


def chapter_playable(counted: DataFrame) -> DataFrame:
    """PF5: ready, partly ready, or under way with something done."""
    done = F.col("voiced") + F.col("failed")
    ok = F.col("status").isin("ready", "partial_ready") | ((done > 0) & F.col("status").isin("processing", "queued"))
    return counted.select("chapter_id", F.coalesce(ok, F.lit(False)).alias("playable"))


def valid_sessions(sessions: DataFrame, users: DataFrame, as_of: Column, max_days: int = 7) -> DataFrame:
    """JN3: sessions (user_id, created_at, expires_at) that hold at ``as_of`` and are young enough, of users that aren't disabled."""
    holds = (F.col("created_at") <= as_of) & (F.col("expires_at") > as_of) & (F.col("created_at") >= as_of - F.make_interval(days=F.lit(max_days)))
    return sessions.where(holds).join(users.where(~F.col("disabled")).select("user_id"), "user_id")


def stored_keys(books: DataFrame, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """(key, book_id) of the four columns that hold keys: a book's cover and file, a chapter's and a segment's audio."""
    below = segments.join(chapters.select("chapter_id", "book_id"), "chapter_id")
    parts = [books.select(F.col(c).alias("key"), "book_id") for c in ("cover_key", "file_key")] + [t.select(F.col("audio_key").alias("key"), "book_id") for t in (chapters, below)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("key IS NOT NULL")


def storage_keys(books: DataFrame, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """SO2: all keys of all books."""
    return stored_keys(books, chapters, segments)


def key_owners(keys: DataFrame, books: DataFrame, chapters: DataFrame, segments: DataFrame, pattern: str) -> DataFrame:
    """JN4: ``keys`` with ``owner``, the user of the book that a key names by ``pattern``, or else that holds it in one of four columns.

    A key has a row for each user who holds it, and one without an owner if none does. A key under the pattern whose book is
    unknown has no owner, whatever the columns hold.
    """
    named = keys.withColumn("book", F.regexp_extract("key", pattern, 1))
    users = books.select(F.col("book_id").cast("string").alias("book"), F.col("user_id").alias("owner"))
    direct = named.where("book <> ''").join(users, "book", "left").select(*keys.columns, "owner")
    other = named.where("book = ''").drop("book")
    held = stored_keys(books, chapters, segments).join(books.select("book_id", F.col("user_id").alias("owner")), "book_id").select("key", "owner").distinct()
    return direct.unionByName(other.join(held, "key", "left").select(*keys.columns, "owner"))


def submissions(new: DataFrame, books: DataFrame) -> DataFrame:
    """JN12: ``new`` (user_id, source_hash, ...) with the least book of that user and hash, and ``kind``: new, existing, retryable (failed, with its file) or conflict (failed, without)."""
    first = books.groupBy("user_id", "source_hash").agg(F.min_by(F.struct("book_id", "status", "file_key"), "book_id").alias("known"))
    failed = F.col("known.status") == "failed"
    kind = F.when(F.col("known").isNull(), "new").when(failed & F.col("known.file_key").isNotNull(), "retryable").when(failed, "conflict").otherwise("existing")
    return new.join(first, ["user_id", "source_hash"], "left").select(*new.columns, F.col("known.book_id").alias("book_id"), kind.alias("kind"))
