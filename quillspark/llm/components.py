"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a group minimum (combined before the shuffle) and an equi-join of the edges with the minima; both sides
of a join are plain tables, so that Spark may split a hot vertex. Steps are written to the shared folder and deleted after
the next. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import delete, stored_at


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) but the smallest of each component; label is that smallest."""
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = stored_at(pairs.distinct())
    state = _state(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least, one = stored_at(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
        large, two = stored_at(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least, three = stored_at(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "w"))
        moved = large.join(least, F.col("a") == F.col("w")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, last = state, path
        now, path = stored_at(moved.unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct())
        delete(spark, last, one, two, three)
        state = _state(now)
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def least_of_each(vertices: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(node, component_id: the least ``key`` in the component of each row of ``vertices`` (node, ``key``), null if there is none)."""
    rooted = vertices.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", key, F.coalesce("label", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min(key).alias("component_id")).withColumnRenamed("root", "of")
    return rooted.join(least, F.col("root") == F.col("of")).select("node", "component_id")
