"""Sinks with merge rules: upsert, insert if absent, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import file_system


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, tie: str | None = None) -> DataFrame:
    """SS3: the row with the greatest ``version`` of each key; ``new`` wins ties, then the greater ``tie``."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc_nulls_last(version), F.desc("_new"), *([F.desc_nulls_last(tie)] if tie else [])]
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_new", "_place")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SS4: ``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def first_of_each(rows: DataFrame, keys: list[str], *arrival: str) -> DataFrame:
    """AG10: the first row of each key by arrival; rows with a null key are left out."""
    by = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in arrival])
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def write_structured(chapters: DataFrame, segments: DataFrame, folder: str, buckets: int = 64) -> None:
    """SS2: both tables as Parquet in folders by a hash of the chapter, so that a reader of one chapter opens one folder and a large book is many.

    A chapter's segments stand in one file, in order.
    """
    bucket = F.pmod(F.xxhash64("chapter_id"), F.lit(buckets)).cast("int")
    for name, rows, order in (("chapters", chapters, ["chapter_id"]), ("segments", segments, ["chapter_id", "segment_index"])):
        dealt = rows.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", *order)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")


def page_files(spark: SparkSession, pattern: str) -> DataFrame:
    """SS1: (path, html) of page files, one row a file."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def reading_order(pages: DataFrame) -> DataFrame:
    """SS1: the pages that are read in line (``linear`` is not 'no'), numbered anew in their book."""
    kept = pages.where(F.coalesce(F.lower("linear"), F.lit("yes")) != "no").drop("linear")
    return kept.withColumn("spine_index", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_index")))


# SS3 on a stream: a table as a log. ``deltas/b{n}`` holds what micro-batch n brings, a row a key, sorted by key; ``base/b{n}`` all up to n.
# ``names/b{n}`` says of which of them the table consists after batch n.


def _last_of_each(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_batch"))
    return rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place", "_batch")


def _named(spark: SparkSession, folder: str) -> list[int]:
    """The batches that have named the table, ascending."""
    files, at = file_system(spark, f"{folder}/names")
    return sorted(int(f.getPath().getName()[1:]) for f in files.listStatus(at)) if files.exists(at) else []


def log_parts(spark: SparkSession, folder: str, number: int | None = None) -> tuple[int | None, list[int]]:
    """(batch of the base, or None; batches of the deltas behind it) of the table after batch ``number``, by default the last."""
    known = [n for n in _named(spark, folder) if number is None or n <= number]
    if not known:
        return None, []
    row = spark.read.parquet(f"{folder}/names/b{known[-1]}").first()
    return row.base, list(row.deltas)


def upserted(spark: SparkSession, folder: str, schema: str, keys: list[str], version: str, number: int | None = None) -> DataFrame:
    """The table that ``upsert_stream`` holds after batch ``number``, by default the last: base and deltas merged, the greatest ``version`` of each key, the later batch on ties."""
    base, deltas = log_parts(spark, folder, number)
    out = spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long"))
    for path, n in [(f"{folder}/base/b{base}", base)] * (base is not None) + [(f"{folder}/deltas/b{d}", d) for d in deltas]:
        out = out.unionByName(spark.read.schema(schema).parquet(path).withColumn("_batch", F.lit(n).cast("long")))
    return _last_of_each(out, keys, version)


def upsert_stream(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], version: str, every: int = 8):
    """SS3 on a stream; returns the started query. A micro-batch is one write, of its own rows; each ``every``-th merges all into a new base.

    Files that neither the last two states of the table name go with that merge, so a reader may finish with the state it began
    with. A batch that is repeated after a failure writes the same folders again.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base, deltas = log_parts(spark, folder, number - 1)
        fresh = _last_of_each(batch.withColumn("_batch", F.lit(number).cast("long")), keys, version)
        fresh.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/deltas/b{number}")
        deltas = [*deltas, number]
        before = ([] if base is None else [f"base/b{base}"]) + [f"deltas/b{d}" for d in deltas[:-1]] + [f"deltas/b{number}"]
        if len(deltas) >= every:
            spark.createDataFrame([(base, deltas)], "base long, deltas array<long>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/names/b{number}")
            upserted(spark, folder, schema, keys, version, number).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{folder}/base/b{number}")
            base, deltas = number, []
        spark.createDataFrame([(base, deltas)], "base long, deltas array<long>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/names/b{number}")
        if base == number:
            _sweep(spark, folder, {f"base/b{number}", *before}, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sweep(spark: SparkSession, folder: str, kept: set[str], number: int) -> None:
    """Delete parts that ``kept`` doesn't hold and names before the last two."""
    for kind in ("base", "deltas", "names"):
        files, at = file_system(spark, f"{folder}/{kind}")
        for f in files.listStatus(at) if files.exists(at) else []:
            name = f.getPath().getName()
            if f"{kind}/{name}" not in kept if kind != "names" else int(name[1:]) < number - 1:
                files.delete(f.getPath(), True)
