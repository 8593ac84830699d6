"""Anchored windows of keys that are too large for one task, by doubling pointers.

Every event points to the next one that a window opened at it would leave out: the first of its key at or behind its own end.
An event whose forerunner lies a whole span back opens a window whatever came before, so a key falls into stretches there. The
events that open windows are those that the first event of a stretch reaches along the pointers; they are marked by joins
in log-many steps: with each, the pointers are composed with themselves and the marked events mark what they point to.
All steps are joins and windows over ranges of the sorted events, none over a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import scan
from quillspark.sources.shared import Steps

#: Row numbers of a sorted table: the number of its range times this, and the place in the range.
RANGE = 1 << 33


def in_ranges(rows: DataFrame, parts: int, *order: Column) -> DataFrame:
    """``rows`` with ``_row``, ascending in ``order`` over the whole table, ranges of like size in its upper bits. Write it before use: another run may cut elsewhere."""
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())


def next_outside(events: DataFrame, key: str, span: int, parts: int, steps: Steps) -> DataFrame:
    """(_row, next): for each event of ``events`` (key, _at, _row) the first one of its key at least ``span`` later, or null."""
    at = events.select(F.col(key).alias("k"), F.col("_at").alias("t"), F.lit(1).alias("event"), F.col("_row").alias("e"))
    ends = events.select(F.col(key).alias("k"), (F.col("_at") + span).alias("t"), F.lit(0).alias("event"), F.col("_row").alias("e"))
    both = steps.keep(in_ranges(at.unionByName(ends), parts, F.col("k"), F.col("t"), F.col("event"), F.col("e")))
    cut = both.withColumn("part", F.floor(F.col("_row") / RANGE))
    seen = F.when(F.col("event") == 1, F.col("e"))
    here = Window.partitionBy("k", "part").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)  # backwards: a frame that grows at its end is read once
    firsts = cut.groupBy("k", "part").agg(F.min(seen).alias("first"))
    later = firsts.select("k", "part", F.last("first", ignorenulls=True).over(Window.partitionBy("k").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    found = cut.withColumn("near", F.last(seen, ignorenulls=True).over(here)).where("event = 0").join(later, ["k", "part"])
    out = steps.keep(found.select(F.col("e").alias("_row"), F.coalesce("near", "later").alias("next")))
    steps.drop(both)
    return out


def anchored_by_doubling(rows: DataFrame, key: str, span: int, tie: str, parts: int) -> DataFrame:
    """``rows`` (with ``_at`` in microseconds) with ``_start``, ``in_window`` and ``opens``, as ``keyed.anchored`` gives them."""
    steps = Steps(rows.sparkSession)
    events = steps.keep(in_ranges(rows, parts, F.col(key), F.col("_at"), F.col(tie)))
    numbered = scan.running(events.select(key, "_at", "_row"), key, "_row", RANGE, number=scan.total(F.lit(1)), past=scan.latest(F.col("_at")))
    numbered = steps.keep(numbered.withColumn("begins", F.col("past").isNull() | (F.col("_at") >= F.col("past") + span)))
    points = next_outside(numbered, key, span, parts, steps)
    # a pointer never leaves its stretch: what begins one is marked already
    begins = numbered.where("begins").select("_row", F.lit(True).alias("known"))
    points = steps.keep(points.where("next IS NOT NULL").join(begins.withColumnRenamed("_row", "next"), "next", "left_anti").select("_row", "next"))
    marked = steps.keep(begins.select("_row"))
    while not points.isEmpty():  # the pointers reach twice as far each time, until none stays in its key
        more = marked.join(points, "_row").select(F.col("next").alias("_row"))
        wider = steps.keep(marked.unionByName(more).distinct())
        onward = points.select(F.col("_row").alias("next"), F.col("next").alias("further"))
        doubled = steps.keep(points.join(onward, "next").select("_row", F.col("further").alias("next")))
        steps.drop(marked, points)
        marked, points = wider, doubled
    opens = numbered.join(marked.withColumn("opens", F.lit(True)), "_row", "left").withColumn("opens", F.coalesce("opens", F.lit(False)))
    opener = F.when(F.col("opens"), F.struct("_at", "number"))
    opens = scan.running(opens.select(key, "_row", "_at", "number", "opens"), key, "_row", RANGE, opener=scan.latest(opener))
    opens = opens.withColumn("opener", F.when(F.col("opens"), F.struct("_at", "number")).otherwise(F.col("opener")))
    out = opens.select("_row", F.col("opener._at").alias("_start"), (F.col("number") - F.col("opener.number") + 1).alias("in_window"), "opens")
    return events.join(out, "_row").select(*rows.columns, "_start", "in_window", "opens")
