"""Running values along a key's rows, without all rows of a key in one task.

Rows of a key are cut into parts by ranges of a whole-number index that orders them (at most ``width`` values each). A window runs
within each part; the parts' totals, a row each, run along the key; what a part's predecessors come to is joined back to it.
So a key with a third of all rows is as many groups as it has parts, and only the totals of a key's parts come together.

The rows are read twice (for the totals and for the windows): give ``running`` narrow rows, or a written table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


@dataclass(frozen=True)
class Along:
    """A running value: within a part, of a whole part, along the parts before, and the two together."""

    within: Callable[[Window], Column]
    of_part: Callable[[Column], Column]
    along: Callable[[Column, Window], Column]
    joined: Callable[[Column, Column], Column]
    every: bool = False  # along all parts of the key, not only those before


def total(value: Column) -> Along:
    """The sum up to and with the row."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Along(lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), lambda order: F.sum(value), lambda c, w: F.sum(c).over(w), lambda here, before: zero(here) + zero(before))


def before(value: Column) -> Along:
    """The sum of the rows before."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Along(lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), lambda order: F.sum(value), lambda c, w: F.sum(c).over(w), lambda here, past: zero(here) + zero(past))


def latest(value: Column) -> Along:
    """The nearest value before the row that isn't null."""
    return Along(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda c, w: F.last(c, ignorenulls=True).over(w), lambda here, past: F.coalesce(here, past))


def whole(value: Column) -> Along:
    """The sum over all rows of the key."""
    return Along(lambda w: F.lit(None), lambda order: F.sum(value), lambda c, w: F.sum(c).over(w), lambda here, all_: all_, True)


def final(value: Column) -> Along:
    """The value of the key's last row."""
    return Along(lambda w: F.lit(None), lambda order: F.max_by(value, order), lambda c, w: F.last(c).over(w), lambda here, all_: all_, True)


def running(rows: DataFrame, key: str, index: str, width: int = WIDTH, **wanted: Along) -> DataFrame:
    """``rows`` with the ``wanted`` columns, along each key in the order of ``index``, a whole number that is unique in its key. Rows without a key or an index are left out."""
    cut = rows.where(F.col(key).isNotNull() & F.col(index).isNotNull()).withColumn("_part", F.floor(F.col(index) / width))
    inside = Window.partitionBy(key, "_part").orderBy(index)
    totals = cut.groupBy(key, "_part").agg(*[a.of_part(F.col(index)).alias(n) for n, a in wanted.items()])
    by_part = Window.partitionBy(key).orderBy("_part")
    past, all_ = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = totals.select(key, "_part", *[a.along(F.col(n), all_ if a.every else past).alias(f"_past_{n}") for n, a in wanted.items()])
    here = cut.select(*cut.columns, *[a.within(inside).alias(f"_here_{n}") for n, a in wanted.items()])
    out = here.join(carried, [key, "_part"])
    return out.select(*rows.columns, *[a.joined(F.col(f"_here_{n}"), F.col(f"_past_{n}")).alias(n) for n, a in wanted.items()])
