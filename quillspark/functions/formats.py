"""Durations, hashes, storage keys, failure classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(ms: Column, hours: bool = False) -> Column:
    """m:ss (or h:mm:ss from an hour on), --:-- for null, negative or non-finite."""
    bad = ms.isNull() | F.isnan(ms.cast("double")) | (ms < 0) | (ms.cast("double") == float("inf"))
    s = F.floor(ms / 1000 + 0.5).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    short = F.concat_ws(":", F.floor(s / 60).cast("string"), two(s % 60))
    if hours:
        short = F.when(s >= 3600, F.concat_ws(":", F.floor(s / 3600).cast("string"), two(F.floor(s % 3600 / 60)), two(s % 60))).otherwise(short)
    return F.when(bad, "--:--").otherwise(short)


def storage_key(book: Column, chapter: Column, segment: Column) -> Column:
    """F26."""
    return F.concat(F.lit("books/"), book.cast("string"), F.lit("/chapters/"), chapter.cast("string"), F.lit("/"), segment.cast("string"), F.lit(".wav"))


def book_of_key(key: Column) -> Column:
    """the owner part of a key, or null."""
    return F.nullif(F.regexp_extract(key, "^books/([^/]+)/", 1), F.lit(""))


def failure_reason(message: Column) -> Column:
    """class of a failure message, by precedence."""
    return F.when(message.rlike("(?i)torrent|torbox"), "download").when(message.rlike("(?i)epub|parse|spine"), "parse").when(message.rlike("(?i)too short|word count"), message).otherwise("unexpected")


def is_retryable(status: Column, is_config_error: Column) -> Column:
    """F28."""
    return ~is_config_error & (status.isNull() | status.isin(408, 409, 425, 429) | (status >= 500))
