"""Files of finished stages: shuffles, and stage tables that only one operator reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tokenloom.session import stage_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Stage = Callable[[DataFrame, str], DataFrame]


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[Stage]:
    """Let Spark delete the shuffle files of every query that ends inside the block. Each of them
    wrote a stage table, so nothing reads those files again; otherwise they would stay on the
    executors' disks until the driver happens to collect its garbage.

    Gives a function that writes a stage table in the shared folder and reads it back; its tables
    are deleted when the block ends, so what is read later must be written otherwise.
    """
    paths: list[str] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        path = stage_path(spark, name)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield stage
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
        for name in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
