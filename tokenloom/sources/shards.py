"""Parquet shards of raw text and of token ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.shards import split_fragments
from tokenloom.sources.storage import qualified

# A fragment's columns, in order.
TOKEN_COLUMNS = ("split", "shard_id", "start", "end", "tokens")


# Bytes that one writing task sorts and writes, about.
TASK_BYTES = 256 << 20


def shard_tasks(spark: SparkSession, shards: int, size: int = 0) -> int:
    """Writing tasks for ``size`` bytes: as many as the session's shuffle partitions, more when
    each would write more than ``TASK_BYTES``, and never more than shards.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(shards, max(partitions, size // TASK_BYTES)))


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Write ``df`` by its partition columns in place of all that is at ``path``, whatever the
    session says about overwriting.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*columns).parquet(path)


def by_task(df: DataFrame, number: Column, shards: int, size: int = 0) -> DataFrame:
    """Neighbouring shards to the same task, every shard whole; adds ``_task``."""
    tasks = shard_tasks(df.sparkSession, shards, size)
    task = F.floor(number.cast("long") * tasks / F.lit(shards)).cast("int")
    return df.withColumn("_task", task).repartitionById(tasks, F.col("_task"))


def write_raw_shards(
    docs: DataFrame, path: str, shards: int, order: tuple[str, ...] = ("pos",), size: int = 0
) -> None:
    """Write ``shard_id`` directories with one file each, documents in order.

    The task follows from the shard number, so no shard is split over two files and tasks are
    even; ``size`` is the bytes to write, where known. Earlier output is replaced, also by an
    empty stream, which writes no file.
    """
    if shards == 0 and not _exists(docs.sparkSession, path):
        return
    placed = by_task(docs, F.col("shard_id"), max(1, shards), size).drop("_task")
    replace_partitions(placed.sortWithinPartitions("shard_id", *order), path, "shard_id")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("text string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_raw_shards(spark: SparkSession, path: str) -> DataFrame:
    """Re-scan raw shards: ``shard_id``, ``pos`` and the other stored columns, empty text dropped.

    A path without shards is an error.
    """
    docs = spark.read.parquet(path)
    return docs.filter(F.length("text") > 0).withColumn("shard_id", F.col("shard_id").cast("long"))


def token_shard_number() -> Column:
    """File number of a fragment: val is 0, train shard k is k + 1."""
    return F.when(F.col("split") == "val", 0).otherwise(F.col("shard_id") + 1).cast("int")


def _token_files(fragments: DataFrame, train_shards: int, size: int = 0) -> DataFrame:
    """Fragments placed by file and in stream order."""
    placed = by_task(fragments.select(*TOKEN_COLUMNS), token_shard_number(), train_shards + 1, size)
    return placed.drop("_task").sortWithinPartitions("split", "shard_id", "start")


def encode_in_place(
    stream: DataFrame, tokenizer, val_tokens: int, shard_tokens: int, total: int, size: int = 0
) -> DataFrame:
    """Token fragments of a positioned text stream ``(start, end, text)``, each in the task that
    writes its file, in stream order.

    Positions say which files a document's ids end in, so the text is placed before it is encoded:
    ids are made, cut and sorted in the writing task and never shuffled. A document that spans the
    files of several tasks is sent to each of them. ``total`` is the number of tokens and ``size``
    the bytes of the stream, where known. A document whose ids are not as many as its positions say
    is an error.
    """
    edge = max(0, int(val_tokens))
    files = -(-max(0, total - edge) // shard_tokens) + 1
    tasks = shard_tasks(stream.sparkSession, files, size)
    task = lambda file: f"cast(floor({file} * {tasks} / {files}) as int)"
    file = lambda at: f"if({at} < {edge}, 0L, ({at} - {edge}) div {shard_tokens} + 1)"
    spans = F.expr(f"sequence({task(file('start'))}, {task(file('(end - 1)'))})")
    placed = (
        stream.filter("end > start")
        .select("start", "end", "text", F.explode(spans).alias("_task"))
        .repartitionById(tasks, F.col("_task"))
        .withColumn("tokens", tokenizer.encode(F.col("text")))
    )
    whole = F.size("tokens") == F.col("end") - F.col("start")
    wrong = F.raise_error(F.lit("the ids of a document do not fill its positions"))
    checked = placed.withColumn(
        "tokens", F.when(whole, F.col("tokens")).otherwise(wrong.cast("array<int>"))
    )
    cut = split_fragments(checked.drop("text"), edge, shard_tokens)
    number = "if(split = 'val', 0L, shard_id + 1)"
    own = cut.filter(F.expr(f"{task(number)} = _task")).select(*TOKEN_COLUMNS)
    return own.sortWithinPartitions("split", "shard_id", "start")


def write_token_shards(
    fragments: DataFrame, path: str, train_shards: int, size: int = 0
) -> None:
    """Write token fragments by ``(split, shard_id)``, one file per shard, in stream order.
    ``size`` is the bytes to write, where known.
    """
    replace_partitions(_token_files(fragments, train_shards, size), path, "split", "shard_id")


def write_encoded_shards(fragments: DataFrame, path: str) -> None:
    """Write fragments that ``encode_in_place`` made, as ``write_token_shards`` would."""
    replace_partitions(fragments, path, "split", "shard_id")


def write_encoded_bins(fragments: DataFrame, path: str) -> None:
    """Export fragments that ``encode_in_place`` made as flat 16-bit files."""
    fragments.write.format("tokenbin").mode("overwrite").save(qualified(fragments.sparkSession, path))


def read_token_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Token fragments; ``split`` prunes directories."""
    fragments = spark.read.parquet(path).select(*TOKEN_COLUMNS)
    fragments = fragments.withColumn("shard_id", F.col("shard_id").cast("long"))
    return fragments.filter(F.col("split") == split) if split else fragments


def write_token_bins(fragments: DataFrame, path: str, train_shards: int, size: int = 0) -> None:
    """Export token fragments as flat 16-bit files, every file by one task."""
    write_encoded_bins(_token_files(fragments, train_shards, size), path)


def read_token_bins(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Flat 16-bit files of an export: its ``train_shards`` folder or one file. A bare path is one
    of the cluster's default file system, as it is for the writers.
    """
    return spark.read.format("tokenbin").options(**options).load(qualified(spark, path))
