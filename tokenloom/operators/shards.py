"""Holdout split and fixed-size shards of the token stream, by position arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default holdout, token shard size and raw shard size, in tokens.
VAL_TOKENS = 1_638_400
TOKEN_SHARD = 100_000_000
RAW_SHARD = 100_000_000


def holdout_size(total: int, cap: int = VAL_TOKENS) -> int:
    """Tokens held out of a stream of ``total``: the cap, or a tenth of the stream if less."""
    return max(0, min(cap, total // 10))


def split_fragments(
    docs: DataFrame, val_tokens: int, shard_tokens: int, tokens: str | None = "tokens"
) -> DataFrame:
    """Cut positioned documents at the holdout edge and at every token-shard edge.

    Gives ``split, shard_id, start, end`` (positions within the split) and, when ``tokens`` names
    the id column, the fragment's ids; other columns pass through. The head of the stream is
    ``val``, the rest ``train`` in shards of exactly ``shard_tokens``, the last one shorter.

    Only ranges are exploded; the ids are sliced in the projection above, inside the same
    generated code, so no row carries a copy of its whole id array.
    """
    if shard_tokens <= 0:
        raise ValueError("the shard size must be positive")
    edge = max(0, int(val_tokens))
    passed = [c for c in docs.columns if c not in ("start", "end", tokens)]
    # At most one range for val, and one per train shard met.
    ranges = F.expr(f"""
        concat(
          if(start < {edge},
             array(named_struct('split', 'val', 'shard_id', 0L,
                                '_lo', start, '_hi', least(end, {edge}L))),
             array()),
          if(end > {edge},
             transform(
               sequence((greatest(start, {edge}L) - {edge}) div {shard_tokens},
                        (end - 1 - {edge}) div {shard_tokens}),
               k -> named_struct('split', 'train', 'shard_id', k,
                                 '_lo', greatest(start, {edge} + k * {shard_tokens}),
                                 '_hi', least(end, {edge} + (k + 1) * {shard_tokens}))),
             array()))
    """)
    held = ["start", "end", tokens] if tokens else ["start", "end"]
    cut = docs.filter("end > start").select(*passed, *held, F.inline_outer(ranges))
    shift = F.when(F.col("split") == "val", F.lit(0)).otherwise(F.lit(edge))
    columns = [
        *passed,
        "split",
        "shard_id",
        (F.col("_lo") - shift).alias("start"),
        (F.col("_hi") - shift).alias("end"),
    ]
    if tokens:
        columns.append(slice_ids(tokens, "_lo", "_hi").alias("tokens"))
    return cut.select(*columns)


def slice_ids(tokens: str, low: str, high: str, start: str = "start") -> Column:
    """Ids at stream positions ``[low, high)`` of an id array that begins at ``start``."""
    return F.slice(
        tokens,
        (F.col(low) - F.col(start) + 1).cast("int"),
        (F.col(high) - F.col(low)).cast("int"),
    )


def shard_table(spark: SparkSession, total: int, shard_tokens: int) -> DataFrame:
    """Ranges ``(shard_id, low, high)`` of a stream of ``total`` cut every ``shard_tokens``."""
    return spark.range(-(-total // shard_tokens)).select(
        F.col("id").alias("shard_id"),
        (F.col("id") * shard_tokens).alias("low"),
        F.least((F.col("id") + 1) * shard_tokens, F.lit(total)).alias("high"),
    )


def shard_stats(docs: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """Documents and tokens per shard."""
    return docs.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n_tokens).alias("tokens")
    )


def split_stats(fragments: DataFrame) -> DataFrame:
    """Fragments, tokens and shards per split."""
    return fragments.groupBy("split").agg(
        F.count(F.lit(1)).alias("fragments"),
        F.sum(F.col("end") - F.col("start")).alias("tokens"),
        (F.max("shard_id") + 1).alias("shards"),
    )
