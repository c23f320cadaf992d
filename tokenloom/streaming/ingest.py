"""Streamed ingest and the budget over a stream.

A budget is one number per source, so the stream keeps it in a ledger and applies the batch
operators to each micro-batch: documents of one source stay spread over all tasks, which a
stateful group per source would bring to one. Writes are by batch number and replace themselves,
so a repeated batch leaves the same result.

A ledger entry is the state of all sources after its batch, so a batch reads one entry, the newest
before it, however long the stream runs; entries that no repeated batch can ask for are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tokenloom.operators.budget import budget_cutoffs, budget_select, truncate_text
from tokenloom.operators.clean import (
    MAX_TOKEN_COUNT,
    is_kept,
    malformed_flag,
    skip_reason,
    skips_read,
    to_documents,
)
from tokenloom.session import broadcast_if_small, settle, stage_path
from tokenloom.sources.storage import delete, names

LEDGER_SCHEMA = "source string, written_tokens long, last_seq long"
ENTRY = "batch_id="


def stream_corpus(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    source: Column,
    seq: Column,
    files_per_trigger: int | None = None,
    name: str = "*.parquet",
) -> DataFrame:
    """Files named like ``name`` in folder ``path``, as they arrive, to ``(source, seq, text,
    malformed)``, broken UTF-8 repaired.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return to_documents(reader.parquet(path), source, seq, flag=True)


def budgeted_ingest(
    docs: DataFrame,
    spec: DataFrame,
    tokenizer,
    out: str,
    checkpoint: str,
    max_tokens: int = MAX_TOKEN_COUNT,
) -> DataStreamWriter:
    """Writer of the budgeted stream; call ``trigger(...).start()`` on it.

    Documents should arrive in ``seq`` order per source. One that comes after a batch which read
    further takes no part: it goes to ``out/late`` whole, counts under the reason ``late``, and the
    stream goes on; so does one without a ``seq``, which has no place in the order. Kept documents
    go to ``out/docs``, documents read by reason to ``out/skips``, and to ``out/ledger`` the tokens
    written and the last ``seq`` read so far.
    """
    if not names(spec.sparkSession, f"{out}/ledger"):
        # An opening entry of zeros, so that every batch finds a ledger.
        opening = spec.select(
            "source",
            F.lit(0).cast("long").alias("written_tokens"),
            F.lit(None).cast("long").alias("last_seq"),
        )
        _put(opening.coalesce(1), out, "ledger", -1)
    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        _take_budget(spec, tokenizer, out, max_tokens)
    )


def _take_budget(
    spec: DataFrame, tokenizer, out: str, max_tokens: int
) -> Callable[[DataFrame, int], None]:
    sources = spec.count()

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state, older = _state(spark, spec, out, batch_id, sources)
        if state.filter("target_tokens > 0").isEmpty():
            return
        reached = state.select("source", "last_seq")
        on_time = F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))
        late = ~F.coalesce(on_time & F.col("seq").isNotNull(), F.lit(False))
        counted = (
            batch.withColumn("n_tokens", tokenizer.count(F.col("text")))
            .join(broadcast_if_small(reached, sources), "source")
            .withColumn("late", late)
            .drop("last_seq")
        )
        reason = F.when(F.col("late"), "late").otherwise(
            skip_reason(F.col("text"), F.col("n_tokens"), max_tokens, malformed_flag(batch))
        )
        path = stage_path(spark, "batch-counts")
        counted.select("source", "seq", "n_tokens", reason.alias("reason")).write.parquet(path)
        counts = spark.read.parquet(path)
        seen = counts.filter("reason <> 'late'").groupBy("source").agg(F.max("seq").alias("high"))
        seen = settle(state.join(seen, "source", "left"), "batch-seen", sources)
        remaining = state.select("source", "target_tokens")
        kept_counts = counts.filter(is_kept())
        cutoffs = settle(budget_cutoffs(kept_counts, remaining), "batch-cutoffs", sources)
        kept = counted.withColumn("reason", reason).filter(is_kept()).drop("reason", "late")
        kept = truncate_text(budget_select(kept, cutoffs, sources), tokenizer)
        _put(kept, out, "docs", batch_id)
        _put(counted.filter("late").drop("late", "n_tokens"), out, "late", batch_id)
        late_docs = counts.filter("reason = 'late'").groupBy("source", "reason")
        late_docs = late_docs.agg(F.count(F.lit(1)).alias("docs"))
        read = skips_read(counts.filter("reason <> 'late'"), cutoffs, sources)
        _put(read.unionByName(late_docs).coalesce(1), out, "skips", batch_id)
        ledger = seen.join(cutoffs.select("source", "written_tokens"), "source").select(
            "source",
            (F.col("written_before") + F.col("written_tokens")).alias("written_tokens"),
            F.coalesce("high", "last_seq").alias("last_seq"),
        )
        _put(ledger.coalesce(1), out, "ledger", batch_id)
        delete(spark, path)
        # The entry that this batch started from stays: the batch may be repeated.
        for entry in older:
            delete(spark, f"{out}/ledger/{ENTRY}{entry}")

    return take


def _put(df: DataFrame, out: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{table}/{ENTRY}{batch_id}")


def _state(
    spark: SparkSession, spec: DataFrame, out: str, batch_id: int, sources: int
) -> tuple[DataFrame, list[int]]:
    """The mixture less what earlier batches wrote, with the last ``seq`` that they read; and the
    numbers of the ledger entries before the one that says so.
    """
    entries = [n.removeprefix(ENTRY) for n in names(spark, f"{out}/ledger") if n.startswith(ENTRY)]
    before = sorted(n for n in map(int, entries) if n < batch_id)
    newest = spark.read.schema(LEDGER_SCHEMA).parquet(f"{out}/ledger/{ENTRY}{before[-1]}")
    written = F.coalesce("written_tokens", F.lit(0).cast("long"))
    state = spec.join(newest, "source", "left").select(
        "source",
        (F.col("target_tokens") - written).alias("target_tokens"),
        written.alias("written_before"),
        "last_seq",
    )
    return settle(state, "state", sources), before[:-1]


def read_skips(spark: SparkSession, out: str) -> DataFrame:
    """Documents read so far by source and reason."""
    skips = spark.read.parquet(f"{out}/skips")
    return skips.groupBy("source", "reason").agg(F.sum("docs").alias("docs"))


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """Documents the stream has kept so far."""
    return spark.read.parquet(f"{out}/docs")


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """Documents that came too late, or without a place in the order."""
    return spark.read.parquet(f"{out}/late")
