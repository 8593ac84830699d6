"""Shared helpers: tables, intermediate results that survive lost executors, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is read in fewer than half as many: a small file is one task else. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def _file_system(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, ``spark.checkpoint.dir``; it goes when the application ends.

    Where that is unset, a new local folder is taken in local mode; on a cluster executors wouldn't see it, so it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    folder = f"{folder}/tables-{sc.applicationId}"
    files, at = _file_system(spark, folder)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return folder


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``stored``, with the table's path, so that it can be deleted before the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here, once computed."""
    return stored_at(df)[0]


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        files, at = _file_system(spark, path)
        files.delete(at, True)


def slices(texts: list[str], max_chars: int = 1_000_000, max_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``max_rows`` ``texts`` that hold about ``max_chars`` characters; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t) > max_chars or i - start == max_rows):
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
