"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import pieces
from tokenloom.llm.collocations import collocations
from tokenloom.llm.decontamination import find_leaks
from tokenloom.llm.jaccard_join import jaccard_components
from tokenloom.llm.language_id import identify
from tokenloom.llm.merkle import verify_documents
from tokenloom.llm.quality import classify
from tokenloom.llm.sharding import shard_rows
from tokenloom.llm.substring_dedup import deduplicate
from tokenloom.llm.token_counts import TokenizerFile, count_tokens
from tokenloom.llm.token_files import token_files
from tokenloom.llm.topk import top_k
from tokenloom.llm.word_dedup import deduplicate_words
from tokenloom.session import stage_path

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth vector among all vectors."""
    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return identify(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of fifty bytes that earlier documents hold, cut from all documents."""
    return deduplicate(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to eight shards of equal counts."""
    return shard_rows(_table(spark, sf_dir, "documents"), shards=8)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read back."""
    tokenizer = TokenizerFile(public_tokenizers.path(BYTES))
    path = stage_path(spark, "token-files")
    return token_files(_table(spark, sf_dir, "documents"), tokenizer, path)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and what they decode to."""
    return pieces.round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, with a cache that starts empty."""
    tokenizer = TokenizerFile(public_tokenizers.path(PIECES))
    cache = stage_path(spark, "token-cache")
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer, cache)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return classify(_table(spark, sf_dir, "documents"))


def op11_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of thirteen words that earlier documents hold, cut from all documents."""
    return deduplicate_words(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language of all documents."""
    return collocations(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, and each document checked against it after a change."""
    return verify_documents(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_sharding": op6_sharding,
    "op7_token_files": op7_token_files,
    "op8_pieces": op8_pieces,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_word_dedup": op11_word_dedup,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}
