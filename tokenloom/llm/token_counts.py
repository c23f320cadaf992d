"""Token counts through a digest cache.

A text's count depends on its normalised content and on the tokenizer's version alone, so counts
are kept in a stored table under the digests of both. A run joins its texts' digests to that table,
encodes each missing content once, appends the new counts, and reads all counts from the table.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.batches import blocks, text_bytes
from tokenloom.session import materialize, ship_package

CACHE_SCHEMA = "digest binary, n_tokens long"
# Bytes of text handed to the library at once, so that its ids never fill a worker's memory.
CALL_BYTES = 1 << 20

# Loaded tokenizers of this worker, by path.
_LOADED: dict[str, Any] = {}


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file that every worker can open at ``path``: ``.model`` files belong to
    sentencepiece, ``.json`` files to tokenizers.
    """

    path: str

    def load(self) -> Any:
        if self.path not in _LOADED:
            if self.path.endswith(".model"):
                import sentencepiece

                _LOADED[self.path] = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                from tokenizers import Tokenizer

                _LOADED[self.path] = Tokenizer.from_file(self.path)
        return _LOADED[self.path]

    def version(self) -> str:
        """Digest of the file and of the library's version."""
        if self.path.endswith(".model"):
            import sentencepiece as library
        else:
            import tokenizers as library
        with open(self.path, "rb") as file:
            content = hashlib.sha256(file.read())
        content.update(f"{library.__name__} {library.__version__}".encode())
        return content.hexdigest()

    def normalised(self, text: Column) -> Column:
        """What the tokenizer cannot tell apart: a sentencepiece model whose normaliser keeps
        texts as they are still takes its own space mark for a space.
        """
        text = F.coalesce(text, F.lit(""))
        if self.path.endswith(".model") and self.load().normalize("a▁ b") == "▁a▁▁b":
            return F.replace(text, F.lit("▁"), F.lit(" "))
        return text

    def lengths(self, texts: list[str]) -> list[int]:
        library = self.load()
        if self.path.endswith(".model"):
            return [len(ids) for ids in library.encode(texts, num_threads=1)]
        encoded = library.encode_batch_fast(texts, add_special_tokens=False)
        return [len(one) for one in encoded]

    def count(self, text: Column) -> Column:
        @F.arrow_udf("long")
        def token_count(texts: pa.Array) -> pa.Array:
            offsets = text_bytes(texts)[0]
            counts: list[int] = []
            for low, high in blocks(offsets, CALL_BYTES):
                counts += self.lengths(texts[low:high].to_pylist())
            return pa.array(counts, pa.int64())

        return token_count(text)


def _version_folder(path: str, version: str) -> str:
    return f"{path.rstrip('/')}/version={version}"


def open_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Counts kept under one tokenizer version, of all runs that have committed; no rows where
    there are none yet.
    """
    reader = spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", True)
    try:
        return reader.parquet(_version_folder(path, version))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], CACHE_SCHEMA)
        raise


def append_counts(counted: DataFrame, path: str, version: str) -> None:
    """Append ``(digest, n_tokens)`` as a folder of this run's own, so that no run's commit touches
    what another one is writing.
    """
    counted.write.parquet(f"{_version_folder(path, version)}/run-{uuid.uuid4().hex}")


def count_tokens(
    docs: DataFrame, tokenizer: TokenizerFile, cache_path: str, limit: int = 4096
) -> DataFrame:
    """Tokens of every whole text, without added special tokens.

    Input: ``doc_id``, ``text``; other columns are ignored. Output, one row per input row:
    ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens). ``cache_path`` is a
    Parquet folder that grows with every run and may be shared by tokenizers.

    Defined cases: a null text counts as empty; an empty text has the library's count (0); equal
    texts are encoded once; null or repeated ``doc_id`` stay as they are; an empty table gives an
    empty result and appends no row. Several runs may use one cache at once; should two append the
    same content, both rows hold the same count and one is read. A text whose count is not in the
    cache after this run's append (a folder deleted meanwhile, say) is an error.
    """
    spark = docs.sparkSession
    ship_package(spark)
    version = tokenizer.version()
    content = tokenizer.normalised(F.col("text"))
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        content.alias("content"),
        F.unhex(F.md5(F.encode(content, "UTF-8"))).alias("digest"),
    )
    known = open_cache(spark, cache_path, version)
    # One text per digest, combined on the map side first: a hot text leaves each task once.
    distinct = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(known.select("digest"), "digest", "left_anti")
    counted = misses.select("digest", tokenizer.count(F.col("content")).alias("n_tokens"))
    append_counts(counted, cache_path, version)
    # The new rows are read from the table, so a lost executor never encodes them again.
    known = open_cache(spark, cache_path, version)
    counts = known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = materialize(counts, "token-counts")
    missing = F.raise_error(F.lit("a text's count is missing from the cache")).cast("long")
    # Both sides are plain shuffles, so that AQE can split the digest of a hot text.
    return (
        keyed.select("doc_id", "n_bytes", "digest")
        .join(counts, "digest", "left")
        .withColumn("n_tokens", F.coalesce("n_tokens", missing))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
