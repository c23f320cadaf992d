"""Dataset metadata, one row per dataset version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: vocabulary size assumed where a dataset records none.
DEFAULT_VOCAB_SIZE = 50_257


def dataset_meta(fragments: DataFrame, tokenizer, shard_tokens: int) -> DataFrame:
    """One row of metadata over token fragments ``(split, shard_id, start, end)``."""
    size = F.col("end") - F.col("start")
    in_train = F.col("split") == "train"
    return fragments.agg(
        F.coalesce(F.sum(F.when(in_train, size)), F.lit(0)).alias("train_tokens"),
        F.coalesce(F.sum(F.when(~in_train, size)), F.lit(0)).alias("val_tokens"),
        F.coalesce(F.max(F.when(in_train, F.col("shard_id"))) + 1, F.lit(0)).alias(
            "num_train_shards"
        ),
    ).select(
        F.lit(tokenizer.vocab_size).cast("long").alias("vocab_size"),
        F.lit(tokenizer.name).alias("tokenizer"),
        "train_tokens",
        "val_tokens",
        "num_train_shards",
        F.lit(shard_tokens).cast("long").alias("bin_shard_tokens"),
        F.lit(tokenizer.add_separator).alias("count_separator_token"),
    )


def pass_columns(meta: DataFrame, block: int, world: int, batch: int, accum: int) -> DataFrame:
    """Add the vocabulary default, the windows of one pass and the iterations that read it."""
    per_step = block * world * batch * accum
    return (
        meta.withColumn("vocab_size", F.coalesce("vocab_size", F.lit(DEFAULT_VOCAB_SIZE)))
        .withColumn(
            "windows_per_pass",
            F.greatest(
                F.expr(f"(train_tokens div {world} - 1) div {block}"), F.lit(0).cast("long")
            )
            * world,
        )
        .withColumn("tokens_per_iter", F.lit(per_step).cast("long"))
        .withColumn("iters_per_pass", F.expr(f"train_tokens div {per_step}"))
    )


def put_meta(meta: DataFrame, path: str, version: str) -> None:
    """Put the row of one dataset version into the metadata table, in place of an earlier row of
    that version; the rows of other versions stay.
    """
    row = meta.withColumn("version", F.lit(version)).withColumn("of", F.md5(F.lit(version)))
    writer = row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("of").parquet(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows with the vocabulary default applied."""
    meta = spark.read.parquet(path).drop("of")
    return meta.withColumn("vocab_size", F.coalesce("vocab_size", F.lit(DEFAULT_VOCAB_SIZE)))
