"""Session helpers: the shared folder for stage tables, and checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A side is broadcast only when its row count is known to be below this.
BROADCAST_ROWS = 1_000_000

# Tables with a known bound up to this many rows may pass through the driver.
LOCAL_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder is lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tokenloom-"))
    return spark.sparkContext.getCheckpointDir()


# Application ids to which this package was already sent.
_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where it is installed on every node or submitted with ``--py-files``.
    """
    application = spark.sparkContext.applicationId
    # Threads of one session may come here at once; a second archive of the name would be refused.
    with _SHIPPING:
        if application in _SHIPPED:
            return
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="tokenloom-"), "tokenloom")
        archive = shutil.make_archive(
            target, "zip", os.path.dirname(package), os.path.basename(package)
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few literal rows as a table that lives in the plan, not in a job's tasks."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(fields)
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)
    return spark.createDataFrame(table, schema)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one stage table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tokenloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage table and read it back.

    Cuts the lineage, survives lost executors, and (unlike a row checkpoint) keeps column
    pruning and predicate pushdown for the stages that read it.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Cut the lineage of a table of at most ``rows`` rows: literal rows of the plan when that bound
    is low (one row per source, segment or shard of an ordinary job), a stage table otherwise.
    """
    if rows > LOCAL_ROWS:
        return materialize(df, name)
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``rows``, the caller's known bound, allows it; else let Spark shuffle."""
    return F.broadcast(df) if rows <= limit else df


def default_buckets(spark: SparkSession) -> int:
    """Bucket count for hashed keys: four per shuffle partition, so hash placement stays even."""
    return min(1 << 20, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
