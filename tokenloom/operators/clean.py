"""Column pruning, empty and oversize guards, and the skip report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import malformed_column, text_column
from tokenloom.session import broadcast_if_small

# Fixed value: largest token count of one document, 2^32 - 1.
MAX_TOKEN_COUNT = 4_294_967_295


def to_documents(
    df: DataFrame, source: Column, seq: Column, text: str = "text", flag: bool = False
) -> DataFrame:
    """``(source, seq, text)`` with the text coerced and repaired; every other column is pruned.
    With ``flag``, ``malformed`` says which texts held broken UTF-8.
    """
    columns = [source.alias("source"), seq.cast("long").alias("seq"), text_column(df, text).alias("text")]
    if flag:
        columns.append(malformed_column(df, text).alias("malformed"))
    return df.select(*columns)


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop null and empty text. Text of white space only stays."""
    return df.filter(F.length(text) > 0)


def drop_oversize(
    df: DataFrame, n_tokens: str = "n_tokens", max_tokens: int = MAX_TOKEN_COUNT
) -> DataFrame:
    """Drop documents that are too long to count, and those that count to nothing."""
    return df.filter((F.col(n_tokens) > 0) & (F.col(n_tokens) <= max_tokens))


def skip_reason(
    text: Column,
    n_tokens: Column,
    max_tokens: int = MAX_TOKEN_COUNT,
    malformed: Column | None = None,
) -> Column:
    """Why a document is skipped, or ``kept``; ``malformed`` is one that is kept after repair."""
    reason = (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(n_tokens.isNull(), "encode_failed")
        .when(n_tokens <= 0, "no_tokens")
        .when(n_tokens > max_tokens, "oversize")
    )
    if malformed is not None:
        reason = reason.when(malformed, "malformed")
    return reason.otherwise("kept")


def is_kept(reason: str = "reason") -> Column:
    """Whether a document with this reason is kept."""
    return F.col(reason).isin("kept", "malformed")


def malformed_flag(df: DataFrame) -> Column | None:
    """The column that says which texts were malformed, where there is one."""
    return F.col("malformed") if "malformed" in df.columns else None


def skip_report(df: DataFrame, max_tokens: int = MAX_TOKEN_COUNT) -> DataFrame:
    """Documents by reason, over ``(source, text, n_tokens)`` and, where known, ``malformed``."""
    reason = skip_reason(F.col("text"), F.col("n_tokens"), max_tokens, malformed_flag(df))
    return df.groupBy("source", reason.alias("reason")).agg(F.count(F.lit(1)).alias("docs"))


def skips_read(counts: DataFrame, cutoffs: DataFrame, sources: int) -> DataFrame:
    """Documents by source and reason, up to where each source stopped. ``counts`` is
    ``(source, seq, reason)``, ``cutoffs`` what ``budget_cutoffs`` gives.
    """
    stop = F.when(F.col("written_tokens") == F.col("target_tokens"), F.col("cut_seq"))
    met = F.col("target_tokens") <= 0
    ends = cutoffs.filter(~met).select("source", stop.alias("stop"))
    read = counts.join(broadcast_if_small(ends, sources), "source")
    return (
        read.filter(F.col("stop").isNull() | (F.col("seq") <= F.col("stop")))
        .groupBy("source", "reason")
        .agg(F.count(F.lit(1)).alias("docs"))
    )


def kept_documents(
    df: DataFrame, n_tokens: Column, max_tokens: int = MAX_TOKEN_COUNT
) -> DataFrame:
    """Non-empty documents with ``n_tokens``, guards applied."""
    return drop_oversize(drop_empty(df).withColumn("n_tokens", n_tokens), max_tokens=max_tokens)
