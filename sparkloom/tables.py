"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir

_written: list[str] = []


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by release() or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    _written.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that cut() has written so far and give their number; for when their readers' results are stored."""
    n = len(_written)
    while _written:
        at, fs = _at(spark, _written.pop())
        fs.delete(at, True)
    return n


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there, and lost executors lose none of it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
