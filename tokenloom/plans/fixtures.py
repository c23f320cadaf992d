"""How the given tables stand in for corpora, run logs and artifact listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.tokenizers import Utf8ByteTokenizer
from tokenloom.operators.clean import kept_documents, to_documents
from tokenloom.operators.order import stream_positions, with_shuffle_key
from tokenloom.operators.prefix import grouped_running
from tokenloom.session import local_table

TOKENIZER = Utf8ByteTokenizer()

# Targets in tokens per document of the table, so that the selection grows with it.
TARGETS_PER_DOC = {"A": 500, "B": 300, "C": 200}
SHARD_TOKENS = 100_000
# Documents per packing task where shards are wide.
SEGMENT_DOCS = 20
VAL_CAP = 1_638
SEED = 42
BLOCK, WORLD, BATCH, ACCUM = 1_024, 8, 4, 2
# Files into which the documents are written where a query reads a corpus of files.
FILES = 8
# Splits into which a scan cuts each of these files, and the bounds of their bytes.
SPLITS, LEAST_SPLIT, MOST_SPLIT = 64, 64 << 10, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixture_source() -> Column:
    """The twenty ``src`` names as three sources of 50, 30 and 20 %."""
    number = F.substring("source", 4, 3).cast("int")
    return F.when(number < 10, "A").when(number < 16, "B").otherwise("C")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, seq, text)``; ``doc_id`` is the input order."""
    return to_documents(table(spark, sf_dir, "documents"), mixture_source(), F.col("doc_id"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return kept_documents(docs, TOKENIZER.count(F.col("text")))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").count()
    rows = [(source, per * docs) for source, per in TARGETS_PER_DOC.items()]
    return local_table(spark, rows, "source string, target_tokens long")


def positioned(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Whole documents in shuffled order with their token ranges."""
    docs = with_shuffle_key(counted(spark, sf_dir), SEED)
    return stream_positions(docs if text else docs.drop("text"))


def total_tokens(df: DataFrame, column: str = "n_tokens") -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def _loss() -> Column:
    """The value as a loss; some event types have none."""
    return F.when(~F.col("event_type").isin("error", "signup"), F.col("value")).alias("loss")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric rows: a user is a run, its events in time order are iterations."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_type").alias("split"),
        _loss(),
        (F.col("event_id") % 8).alias("rank"),
    )
    events = events.withColumn("_us", F.unix_micros("ts"))
    numbered = grouped_running(
        events, ["run"], "_us", ["ts", "event_id"], sums={"iter": F.lit(1).cast("long")}
    )
    return numbered.drop("_us")


def _odd(step: str) -> Column:
    return F.lit(f"ckpt_{step}.pt")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a listing of files: three runs in four have numbered artifacts. Among the names
    are a number beyond 64 bits and one without a number.
    """
    events = table(spark, sf_dir, "events")
    folder = F.concat(F.lit("out/run"), F.col("user_id").cast("string"), F.lit("/"))
    numbered = F.concat(
        F.lit("ckpt_"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".pt")
    )
    name = (
        F.when(F.col("event_type") == "purchase", F.concat(numbered, F.lit(".tmp")))
        .when(F.col("event_type") == "signup", "best.pt")
        .when((F.col("event_type") == "error") & (F.col("user_id") % 8 == 0), "ckpt.pt")
        .when((F.col("event_type") == "error") & (F.col("user_id") % 8 == 1), _odd("9" * 20))
        .when((F.col("event_type") == "error") & (F.col("user_id") % 8 == 4), _odd("final"))
        .when(F.col("user_id") % 4 == 0, F.concat(F.lit("log_"), numbered))
        .otherwise(numbered)
    )
    return events.select(
        F.col("user_id").alias("run"),
        F.concat(folder, name).alias("path"),
        F.col("event_id").alias("step"),
        _loss(),
    )
