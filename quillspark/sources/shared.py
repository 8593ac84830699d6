"""Intermediate tables in the folder that driver and executors share, so that lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str) -> tuple:
    """(the file system of a path, the path) of the JVM."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, gone when the application ends. Where that is unset, a local folder in local mode, an error on a cluster."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    folder = f"{folder}/steps-{sc.applicationId}"
    files, at = file_system(spark, folder)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return folder


class Steps:
    """Tables written between the steps of a job; ``drop`` deletes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, computed once, written and read again."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if path := getattr(df, "_kept_at", None):
                files, at = file_system(self.spark, path)
                files.delete(at, True)
