"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; its
result is written as Parquet and read again as the next one's input. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import pieces
from tokenloom.llm.decontamination import drop_leaks
from tokenloom.llm.jaccard_join import keep_one
from tokenloom.llm.language_id import keep_identified
from tokenloom.llm.substring_dedup import keep_unrepeated
from tokenloom.session import stage_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: null, empty and letterless texts too. Repeated rows
    have one fate, texts of any length are read whole, an empty table stays empty.
    """
    return keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one of smallest ``doc_id``, null ids last.
    Texts without words are like no other and stay; an empty table stays empty.
    """
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of fifty bytes that an earlier document holds; documents stay, if emptied. Null
    and short texts lose nothing, null ids come last; an empty table stays empty.
    """
    return keep_unrepeated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage. Null and empty texts stay, and all documents
    where there is no benchmark; an empty table stays empty.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text; a null or empty text has none."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.with_ids(docs.select("doc_id", "source", "lang", "text"), path)
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

# Language ID is a fitted model and SentencePiece a library's file: no SQL gives these rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage tables go to the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
