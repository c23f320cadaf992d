"""Corpus scans: Parquet, JSON lines, and text with one document per line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tokenloom.functions.text import coerce_to_text, repair_utf8, text_column
from tokenloom.session import broadcast_if_small, materialize

# Bits of ``seq`` that number a file's rows; the bits above number the files.
ROW_BITS = 40

FORMATS = ("parquet", "json", "text")

Paths = str | Sequence[str]


def scan_corpus(
    spark: SparkSession,
    paths: Mapping[str, Paths],
    text: str = "text",
    file_format: str = "parquet",
    json_type: str = "string",
    json_mode: str = "FAILFAST",
) -> DataFrame:
    """Datasets by name to ``(source, seq, text)``, each in file-name and row order.

    A dataset is a path or a list of files. Only the text column is read. ``parquet`` rows are
    numbered by Spark itself. ``json`` holds an object per line, whose field ``text`` has
    ``json_type`` (another value takes its JSON form; a missing one is null); a broken line fails the
    job, or with ``json_mode`` ``PERMISSIVE`` is a null text; blank lines are no documents. ``text``
    holds a document per line, a blank line being an empty one. Lines are numbered from the start
    of their file whatever the splits: one narrow pass counts the lines of each split.
    """
    if file_format not in FORMATS:
        raise ValueError(f"file_format must be one of {FORMATS}")
    if file_format == "parquet":
        scans = [_scan(spark, name, path, text) for name, path in paths.items()]
    else:
        read = _json_text(text, json_type, json_mode) if file_format == "json" else _plain_text
        scans = [_scan_lines(spark, name, path, read) for name, path in paths.items()]
    union = scans[0]
    for scan in scans[1:]:
        union = union.unionByName(scan)
    return union


def corpus_files(spark: SparkSession, path: Paths, file_format: str = "parquet") -> list[str]:
    """The files of a dataset in the order of their numbers."""
    reader = spark.read.format("parquet" if file_format == "parquet" else "text")
    found = reader.load(path if isinstance(path, str) else list(path)).inputFiles()
    return sorted(unquote(file) for file in found)


def _seq(number: Column, row: Column) -> Column:
    return F.shiftleft(number, ROW_BITS).bitwiseOR(row)


def _scan(spark: SparkSession, name: str, path: Paths, text: str) -> DataFrame:
    files = spark.read.parquet(*([path] if isinstance(path, str) else path))
    # One row per file: as many as the listing that the driver already holds to plan the scan.
    by_name = Window.orderBy("_file")
    names = files.select(F.col("_metadata.file_path").alias("_file")).distinct()
    numbers = names.select("_file", (F.row_number().over(by_name) - 1).cast("long").alias("_number"))
    count = len(files.inputFiles())
    rows = files.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
        text_column(files, text).alias("text"),
    )
    return rows.join(broadcast_if_small(numbers, count), "_file").select(
        F.lit(name).alias("source"), _seq(F.col("_number"), F.col("_row")).alias("seq"), "text"
    )


def _plain_text(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", repair_utf8(F.col("value")))


def _json_text(text: str, json_type: str, mode: str):
    field = T.StructField(text, T.DataType.fromDDL(json_type))

    def read(lines: DataFrame) -> DataFrame:
        told = lines.filter(F.length(F.trim("value")) > 0)
        value = F.from_json(repair_utf8(F.col("value")), T.StructType([field]), {"mode": mode})
        return told.withColumn("text", coerce_to_text(value[text], field.dataType))

    return read


def _scan_lines(spark: SparkSession, name: str, path: Paths, read) -> DataFrame:
    """Lines numbered by file, split and place in the split.

    A task reads its splits one after the other, so the generated ids of a split's lines follow
    each other; the first of them and the lines of earlier splits of the file make them line
    numbers. Both scans plan the same splits. The table of splits has one row each.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    splits = lines.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_id").alias("_first")
    )
    splits = materialize(splits, "splits")
    by_file = Window.partitionBy("_file").orderBy("_block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    files = splits.select("_file").distinct()
    numbers = files.select(
        "_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_number")
    )
    placed = splits.join(numbers, "_file").select(
        "_file",
        "_block",
        "_number",
        (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    joined = lines.join(broadcast_if_small(placed, splits.count()), ["_file", "_block"])
    row = F.col("_id") + F.col("_shift")
    return read(joined).select(
        F.lit(name).alias("source"), _seq(F.col("_number"), row).alias("seq"), "text"
    )
