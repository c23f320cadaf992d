"""The whole preparation job: corpora to shuffled raw shards, token shards and metadata.

Text is scanned twice and shuffled once. Everything that decides where a document goes (counts,
budgets, order, shard edges) runs on narrow rows without text; the second scan reads only the
documents inside the budgets, finds each one's shard by its key, and writes it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.operators.budget import (
    budget_cutoffs,
    budget_report,
    budget_select,
    truncate_text,
)
from tokenloom.operators.clean import MAX_TOKEN_COUNT, is_kept, malformed_flag, skip_reason, skips_read
from tokenloom.operators.lookup import interval_lookup
from tokenloom.operators.nextfit import assign_shards, max_shards, next_fit_cuts
from tokenloom.operators.order import stream_positions, with_shuffle_key
from tokenloom.operators.shards import (
    RAW_SHARD,
    TOKEN_SHARD,
    VAL_TOKENS,
    holdout_size,
)
from tokenloom.session import broadcast_if_small, materialize, settle
from tokenloom.sources.corpus import Paths, scan_corpus
from tokenloom.sources.metadata import dataset_meta, put_meta
from tokenloom.sources.shards import (
    by_task,
    encode_in_place,
    read_raw_shards,
    read_token_shards,
    replace_partitions,
    write_encoded_shards,
)
from tokenloom.sources.zones import count_until_met

# Fixed value: the shuffle seed.
SEED = 42

# Bytes of text that a token stands for, at most on average, when writing tasks are sized.
TOKEN_BYTES = 4

# Bits of a key that the shard lookup treats as a number.
KEY_BITS = 60


@dataclass(frozen=True)
class Prepared:
    """Paths written, shard counts, and the two reports as stage tables."""

    raw_path: str
    token_path: str
    meta_path: str
    raw_shards: int
    train_shards: int
    report: DataFrame
    skipped: DataFrame


def count_documents(
    docs: DataFrame, spec: DataFrame, tokenizer, max_tokens: int = MAX_TOKEN_COUNT
) -> DataFrame:
    """Stored narrow table ``(source, seq, n_tokens, reason)`` of the mixture's sources. Where
    ``docs`` says which texts were ``malformed``, the reason of those kept does too.
    """
    wanted = docs.join(
        broadcast_if_small(spec.select("source"), spec.count()), "source", "left_semi"
    )
    reason = skip_reason(F.col("text"), F.col("n_tokens"), max_tokens, malformed_flag(docs))
    counted = wanted.withColumn("n_tokens", tokenizer.count(F.col("text")))
    return materialize(
        counted.select("source", "seq", "n_tokens", reason.alias("reason")), "counts"
    )


def _key_number() -> Column:
    return F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("long")


def prepare(
    docs: DataFrame,
    spec: DataFrame,
    tokenizer,
    out: str,
    version: str = "v1",
    seed: int = SEED,
    raw_limit: int = RAW_SHARD,
    token_limit: int = TOKEN_SHARD,
    val_cap: int = VAL_TOKENS,
    max_tokens: int = MAX_TOKEN_COUNT,
) -> Prepared:
    """Run the job over ``docs`` ``(source, seq, text)`` and the mixture ``spec``."""
    counts = count_documents(docs, spec, tokenizer, max_tokens)
    return prepare_counted(docs, counts, spec, tokenizer, out, version, seed, raw_limit,
                           token_limit, val_cap, max_tokens)


def prepare_corpora(
    spark: SparkSession,
    paths: Mapping[str, Paths],
    spec: DataFrame,
    tokenizer,
    out: str,
    file_format: str = "parquet",
    text: str = "text",
    max_tokens: int = MAX_TOKEN_COUNT,
    **limits,
) -> Prepared:
    """Run the job over datasets by name, opening only the files that the budgets need: files are
    counted in their order until a source's target is met, and the second scan reads the files up
    to the one in which it is. A source not read to its end has no ``available_tokens``.
    """
    counted = count_until_met(spark, paths, spec, tokenizer, max_tokens, file_format, text)
    if not any(counted.files.values()):
        raise ValueError("no documents inside the budgets")
    docs = scan_corpus(spark, {s: f for s, f in counted.files.items() if f}, text, file_format)
    done = prepare_counted(
        docs, counted.counts, spec, tokenizer, out, max_tokens=max_tokens, **limits
    )
    ended = counted.ended
    report = done.report.join(broadcast_if_small(ended, len(counted.files)), "source").select(
        *[
            F.when(F.col("ended"), F.col(c)).alias(c) if c == "available_tokens" else F.col(c)
            for c in done.report.columns
        ]
    )
    return replace(done, report=report)


def prepare_counted(
    docs: DataFrame,
    counts: DataFrame,
    spec: DataFrame,
    tokenizer,
    out: str,
    version: str = "v1",
    seed: int = SEED,
    raw_limit: int = RAW_SHARD,
    token_limit: int = TOKEN_SHARD,
    val_cap: int = VAL_TOKENS,
    max_tokens: int = MAX_TOKEN_COUNT,
) -> Prepared:
    """The job after counting. ``counts`` is stored, ``(source, seq, n_tokens, reason)``."""
    raw_path, token_path, meta_path = f"{out}/raw", f"{out}/tokens", f"{out}/meta"
    sources = spec.count()

    kept_counts = counts.filter(is_kept()).select("source", "seq", "n_tokens")
    cutoffs = settle(budget_cutoffs(kept_counts, spec), "cutoffs", sources)
    selected = budget_select(kept_counts, cutoffs, sources)

    keyed = with_shuffle_key(selected, seed).drop("n_tokens", "is_truncated")
    placed = materialize(stream_positions(keyed, "kept_tokens"), "positions")
    total, rows = placed.agg(F.max("end"), F.count(F.lit(1))).first()
    if not rows:
        raise ValueError("no documents inside the budgets")
    bound = max_shards(raw_limit, total)
    cuts = settle(next_fit_cuts(placed, raw_limit, total, rows), "shards", bound)
    raw_shards = cuts.count()

    _write_raw(docs, cutoffs, sources, tokenizer, placed, cuts, raw_limit, raw_shards, seed,
               max_tokens, total, raw_path)
    train_shards = _write_tokens(docs.sparkSession, tokenizer, raw_path, token_path, raw_shards,
                                 token_limit, val_cap)

    fragments = read_token_shards(docs.sparkSession, token_path)
    put_meta(dataset_meta(fragments, tokenizer, token_limit), meta_path, version)
    return Prepared(
        raw_path,
        token_path,
        meta_path,
        raw_shards,
        train_shards,
        budget_report(cutoffs),
        skips_read(counts, cutoffs, sources),
    )


def shard_key_bounds(placed: DataFrame, cuts: DataFrame, limit: int, shards: int) -> DataFrame:
    """``(shard_id, first, next_first, low, high)``: each shard's range of sort keys.

    The first shard starts at the lowest key and the last ends at the highest. ``low`` and
    ``high`` are the numeric heads of the keys, for the lookup's cells.
    """
    sort_key = F.struct("key", "source", "seq")
    firsts = assign_shards(placed, cuts, limit, shards).groupBy("shard_id").agg(
        F.min(sort_key).alias("first")
    )
    after = F.lead("first").over(Window.orderBy("shard_id"))
    head = lambda c: F.conv(F.substring(f"{c}.key", 1, KEY_BITS // 4), 16, 10).cast("long")
    return firsts.withColumn("next_first", after).select(
        F.col("shard_id").cast("int").alias("shard_id"),
        "first",
        "next_first",
        head("first").alias("low"),
        F.coalesce(head("next_first") + 1, F.lit(1 << KEY_BITS)).alias("high"),
    )


def _write_raw(
    docs, cutoffs, sources, tokenizer, placed, cuts, limit, shards, seed, max_tokens, total, path
) -> None:
    chosen = docs.filter(F.length("text") > 0)
    chosen = chosen.withColumn("n_tokens", tokenizer.count(F.col("text"))).filter(
        F.col("n_tokens") <= max_tokens
    )
    texts = truncate_text(budget_select(chosen, cutoffs, sources), tokenizer)
    keyed = with_shuffle_key(texts, seed).withColumn("_number", _key_number())
    bounds = settle(shard_key_bounds(placed, cuts, limit, shards), "bounds", shards)
    sort_key = F.struct("key", "source", "seq")
    homed = interval_lookup(
        keyed,
        bounds,
        "_number",
        "low",
        "high",
        (1 << KEY_BITS) // shards,
        shards,
        ["shard_id", "first", "next_first"],
    ).filter(
        (sort_key >= F.col("first"))
        & (F.col("next_first").isNull() | (sort_key < F.col("next_first")))
    )
    # Neighbouring shards share a task, as many as its share of the bytes allows; their rows are
    # sorted once, for the window, and that is also the order in which they are written.
    #
    # The stored text is encoded again later, so its own count fixes its place in the stream: a
    # cut inside a character makes it differ from the recorded count, and text cut to nothing
    # has none.
    cut_text = F.when(F.col("is_truncated") & (F.length("text") > 0), F.col("text"))
    again = F.when(
        F.col("is_truncated"), F.coalesce(tokenizer.count(cut_text), F.lit(0))
    ).otherwise(F.col("n_tokens"))
    order = Window.partitionBy("shard_id").orderBy("key", "source", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stored = (
        homed.withColumn("n_tokens", again.cast("long"))
        .transform(lambda df: by_task(df, F.col("shard_id"), shards, TOKEN_BYTES * total))
        .drop("_task")
        .select(
            "shard_id",
            (F.row_number().over(order) - 1).cast("long").alias("pos"),
            "text",
            F.col("kept_tokens").alias("recorded_tokens"),
            "n_tokens",
            F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"),
        )
    )
    replace_partitions(stored, path, "shard_id")


def raw_stream(raw: DataFrame, shards: int) -> DataFrame:
    """Stored raw documents with their token range ``[start, end)`` in the whole stream.

    Each file already holds the running total of its shard, so only one offset per shard is
    added; nothing is sorted or shuffled again.
    """
    sizes = raw.groupBy("shard_id").agg(F.sum("n_tokens").alias("_size"))
    earlier = Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "shard_id", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    start = F.col("_offset") + F.col("shard_start")
    return raw.join(broadcast_if_small(offsets, shards), "shard_id").select(
        "shard_id", "pos", "text", start.alias("start"), (start + F.col("n_tokens")).alias("end")
    )


def _write_tokens(spark, tokenizer, raw_path, token_path, raw_shards, limit, val_cap) -> int:
    raw = read_raw_shards(spark, raw_path)
    total = raw.agg(F.sum("n_tokens")).first()[0] or 0
    val_tokens = holdout_size(total, val_cap)
    stream = raw_stream(raw, raw_shards)
    fragments = encode_in_place(
        stream, tokenizer, val_tokens, limit, total, TOKEN_BYTES * total
    )
    write_encoded_shards(fragments, token_path)
    return -(-(total - val_tokens) // limit)
