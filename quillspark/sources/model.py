"""The model tables, mapped from the driver tables; each has the same mapping as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is read in fewer than half as many: a small file is one task else."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def _case(column: str, pairs: dict[str, str]) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


def _case_sql(column: str, pairs: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


BOOK_STATUS = {"AUTOMOBILE": "discovering", "BUILDING": "in_progress", "FURNITURE": "ready", "HOUSEHOLD": "failed", "MACHINERY": "in_progress"}
CHAPTER_STATUS = {"O": "queued", "P": "processing", "F": "ready"}
SEGMENT_STATUS = {"AF": "voiced", "AO": "voiced", "NF": "queued", "NO": "pending", "RF": "failed", "RO": "processing"}
EVENT_STATUS = {"signup": "discovering", "view": "in_progress", "click": "segment_ready", "purchase": "ready", "error": "failed"}


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("book_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("title"), _case("c_mktsegment", BOOK_STATUS).alias("status"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_orderkey").alias("chapter_id"), F.col("o_custkey").alias("book_id"), F.row_number().over(by).alias("chapter_index"), _case("o_orderstatus", CHAPTER_STATUS).alias("status"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("pair", F.concat("l_returnflag", "l_linestatus"))
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    status = _case("pair", SEGMENT_STATUS)
    return line.select(
        F.col("l_orderkey").alias("chapter_id"), F.row_number().over(by).alias("segment_index"), status.alias("status"),
        F.when(status == "voiced", (F.col("l_quantity") * 100).cast("int")).alias("duration_ms"),
        (F.col("l_partkey") % 5 == 0).alias("is_scene_break"), (F.col("l_suppkey") % 6).alias("attempts"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("scene "), F.col("l_partkey").cast("string"))).alias("scene_summary"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("raw_text"),
        F.when(F.col("l_suppkey") % 4 != 0, F.element_at(F.array(F.lit("active"), F.lit("waiting"), F.lit("failed")), (F.col("l_suppkey") % 3 + 1).cast("int"))).alias("job_state"),
    )


def playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("book_id"), "event_id", "ts", F.round(F.col("value") * 1000).cast("int").alias("position_ms"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("book_id"), _case("event_type", EVENT_STATUS).alias("status"), F.col("value"), "props")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    place = scan.running(p.select(host.alias("book_id"), "page_id"), "book_id", "page_id", spine_index=scan.total(F.lit(1)))  # without the html
    read = p.select(host.alias("book_id"), "page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), "url", "html")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return read.repartition(tasks, "page_id").join(place.select("page_id", F.col("spine_index").cast("int").alias("spine_index")), "page_id").select(*read.columns, "spine_index")


def chapter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_id, text): documents as chapters of the book that their source stands for."""
    d = spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    return d.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), "text")


_SQL = {
    "books": f"SELECT c_custkey AS book_id, c_nationkey AS user_id, c_name AS title, {_case_sql('c_mktsegment', BOOK_STATUS)} AS status FROM customer",
    "chapters": f"SELECT o_orderkey AS chapter_id, o_custkey AS book_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS chapter_index, {_case_sql('o_orderstatus', CHAPTER_STATUS)} AS status FROM orders",
    "segments": f"""SELECT l_orderkey AS chapter_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS segment_index,
      {_case_sql('l_returnflag || l_linestatus', SEGMENT_STATUS)} AS status,
      CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity * 100 AS INTEGER) END AS duration_ms, l_partkey % 5 = 0 AS is_scene_break, l_suppkey % 6 AS attempts,
      CASE WHEN l_partkey % 3 = 0 THEN 'scene ' || l_partkey END AS scene_summary, 'part ' || l_partkey AS raw_text,
      CASE WHEN l_suppkey % 4 <> 0 THEN ['active', 'waiting', 'failed'][CAST(l_suppkey % 3 + 1 AS INTEGER)] END AS job_state FROM lineitem""",
    "playback": "SELECT user_id AS book_id, event_id, ts, CAST(round(value * 1000) AS INTEGER) AS position_ms FROM events",
    "event_log": f"SELECT event_id, ts, user_id AS book_id, {_case_sql('event_type', EVENT_STATUS)} AS status, value, props FROM events",
    "pages_in": """SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_id) AS INTEGER) AS spine_index FROM (
      SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS book_id, page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, url, html FROM pages)""",
}


def with_model(*names: str) -> str:
    """``WITH`` clause that defines model tables for a twin."""
    return "WITH " + ",\n".join(f"{n} AS ({_SQL[n]})" for n in names) + "\n"
