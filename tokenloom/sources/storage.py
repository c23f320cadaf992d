"""Small file operations on the file system that a path names, through Spark's own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named, named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system spelt out; a bare path is one of the default file system."""
    named, system = _path(spark, path)
    return system.makeQualified(named).toString()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    named, system = _path(spark, folder)
    if not system.exists(named):
        return []
    return [status.getPath().getName() for status in system.listStatus(named)]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    named, system = _path(spark, path)
    return system.getContentSummary(named).getLength()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a whole folder, if it is there."""
    named, system = _path(spark, path)
    system.delete(named, True)
