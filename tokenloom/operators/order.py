"""Seeded global shuffle and stream positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.keys import key_bucket, shuffle_key
from tokenloom.operators.prefix import hashed_prefix_sum


def with_shuffle_key(
    df: DataFrame, seed: int, identity: Sequence[str] = ("source", "seq"), key: str = "key"
) -> DataFrame:
    """Add the seeded key. ``identity`` must name each row uniquely."""
    return df.withColumn(key, shuffle_key(seed, *identity))


def global_shuffle(
    df: DataFrame,
    seed: int,
    identity: Sequence[str] = ("source", "seq"),
    partitions: int | None = None,
) -> DataFrame:
    """Rows in key order, ties in input order: partition i sorts before partition i+1.

    The digest is uniform, so equal key ranges are equal shares and no sampling job is needed
    to find range bounds; a retried task places its rows as before.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_shuffle_key(df, seed, identity)
    return keyed.repartitionById(
        partitions, key_bucket(F.col("key"), partitions)
    ).sortWithinPartitions("key", *identity)


def stream_positions(
    df: DataFrame,
    n_tokens: str = "n_tokens",
    key: str = "key",
    ties: Sequence[str] = ("source", "seq"),
    buckets: int | None = None,
) -> DataFrame:
    """Add ``pos`` (rank in shuffled order) and the token range ``[start, end)`` of each row."""
    return hashed_prefix_sum(df, n_tokens, key, ties, buckets)
