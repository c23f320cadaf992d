"""Faults that ordinary tables do not show: refused texts, null losses, many sources, reruns."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions.tokenizers import ExternalTokenizer, Utf8ByteTokenizer
from tokenloom.operators.budget import mixture
from tokenloom.operators.runlog import best_so_far, latest_artifact, retention
from tokenloom.plans.prepare import prepare
from tokenloom.sources.metadata import dataset_meta, put_meta, read_meta
from tokenloom.sources.shards import read_raw_shards, shard_tasks, write_raw_shards
from tokenloom.sources.tokenbin import file_order
from tokenloom.streaming.metrics import live_best


def test_special_literals_are_text(spark):
    def load():
        import tiktoken

        ranks = {bytes([i]): i for i in range(256)}
        return tiktoken.Encoding(
            "bytes", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={"<end>": 256}
        )

    tok = ExternalTokenizer("bytes", load, vocab_size=257, separator_id=256)
    df = spark.createDataFrame([("hi <end> x",)], "text string")
    ids = tok.encode(F.col("text"))
    row = df.select(tok.count(F.col("text")).alias("n"), tok.decode(ids).alias("back")).first()
    assert (row["n"], row["back"]) == (11, "hi <end> x")


def test_a_failing_loader_fails_the_job(spark):
    def missing():
        raise FileNotFoundError("no vocabulary here")

    tok = ExternalTokenizer("missing", missing, vocab_size=1, separator_id=0)
    df = spark.createDataFrame([("a",)], "text string")
    for column in (tok.count(F.col("text")), tok.decode(F.array(F.lit(1)))):
        with pytest.raises(Exception, match="no vocabulary here"):
            df.select(column).collect()


def test_loaders_of_one_name_are_told_apart(spark):
    def encoder(shift):
        class Shifted:
            def encode(self, text):
                return [ord(c) + shift for c in text]

        return Shifted()

    df = spark.createDataFrame([("a",)], "text string").coalesce(1)
    for shift in (1, 2):
        tok = ExternalTokenizer("same", lambda shift=shift: encoder(shift), 300, 0, False)
        assert df.select(tok.encode(F.col("text")).alias("i")).first()["i"] == [97 + shift]


def test_only_the_leading_separator_is_stripped(spark):
    tok = Utf8ByteTokenizer()
    df = spark.createDataFrame([([256, 72, 105],), ([72, 105],), ([],), (None,)], "ids array<int>")
    texts = [r[0] for r in df.coalesce(1).select(tok.decode(F.col("ids"))).collect()]
    assert texts == ["Hi", "Hi", "", ""]
    for bad in ([256, 72, 256], [300], [-1]):
        with pytest.raises(Exception, match="outside 0..255"):
            spark.createDataFrame([(bad,)], "ids array<int>").select(tok.decode(F.col("ids"))).collect()


def test_null_losses_are_never_best(spark):
    nan = float("nan")
    rows = [("a", "p0", 0, 2.0), ("a", "p1", 1, 1.0), ("a", "p2", 2, None), ("a", "p3", 3, 3.0)]
    rows += [("b", "q1", 1, None), ("b", "q2", 2, nan)]
    df = spark.createDataFrame(rows, "run string, path string, step long, loss double")
    got = {r["path"]: (r["is_latest"], r["is_best"], r["keep"]) for r in retention(df).collect()}
    assert got["p1"] == (False, True, True) and got["p2"] == (False, False, False)
    assert got["q1"] == (False, False, False) and got["q2"] == (True, False, True)
    tracked = best_so_far(df.withColumnRenamed("step", "iter")).collect()
    assert {r["path"] for r in tracked if r["is_best"]} == {"p0", "p1"}
    assert all(r["is_best"] is not None and r["is_saved"] is not None for r in tracked)
    live = {r["run"]: r for r in live_best(df.withColumnRenamed("step", "iter")).collect()}
    assert (live["a"]["loss"], live["a"]["iter"], live["a"]["is_saved"]) == (1.0, 1, True)
    assert (live["b"]["loss"], live["b"]["is_saved"]) == (None, False)


def test_iteration_zero_is_best_but_not_saved(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 2.0)], "run string, iter long, loss double")
    row = live_best(df).first()
    assert (row["loss"], row["iter"], row["is_saved"]) == (1.0, 0, False)


def test_odd_artifact_names(spark):
    rows = [("a", "out/a/ckpt_99999999999999999999.pt"), ("a", "out/a/ckpt_7.pt")]
    rows += [("b", "out/b/ckpt_final.pt"), ("b", "out/b/ckpt.pt"), ("c", "out/c/ckpt_1.pt.tmp")]
    df = spark.createDataFrame(rows, "run string, path string")
    got = {r["run"]: (r["path"], r["step"]) for r in latest_artifact(df).collect()}
    assert got == {
        "a": ("out/a/ckpt_7.pt", 7),
        "b": ("out/b/ckpt_final.pt", None),
        "c": (None, None),
    }


def test_two_thousand_sources(spark, out):
    docs = spark.range(4_000).select(
        F.concat(F.lit("s"), F.col("id") % 2_000).alias("source"),
        F.col("id").alias("seq"),
        F.lit("text").alias("text"),
    )
    spec = mixture(spark, {f"s{i}": 7 for i in range(2_000)})
    done = prepare(docs, spec, Utf8ByteTokenizer(), out, raw_limit=4_000, token_limit=5_000, val_cap=10)
    assert done.report.agg(F.sum("written_tokens")).first()[0] == 14_000


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_a_smaller_rerun_leaves_no_old_shard(spark, out, mode):
    docs = spark.range(5).select(
        F.col("id").cast("int").alias("shard_id"), F.lit(0).alias("pos"), F.lit("t").alias("text")
    )
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        write_raw_shards(docs, out + "/raw", 5)
        write_raw_shards(docs.filter("shard_id < 2"), out + "/raw", 2)
        assert read_raw_shards(spark, out + "/raw").count() == 2
        write_raw_shards(docs.limit(0), out + "/raw", 0)
        with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
            read_raw_shards(spark, out + "/raw")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_one_metadata_row_per_version(spark, out):
    fragments = spark.createDataFrame(
        [("train", 0, 0, 10)], "split string, shard_id long, start long, end long"
    )
    for _ in range(2):
        for version in ("v1", "01"):
            put_meta(dataset_meta(fragments, Utf8ByteTokenizer(), 10), out + "/meta", version)
    assert sorted(r["version"] for r in read_meta(spark, out + "/meta").collect()) == ["01", "v1"]


def test_files_are_ordered_by_number():
    names = [f"x/train_shards/shard_{i:05d}.bin" for i in (2, 10_001, 99_999, 100_000, 100_001)]
    assert sorted(sorted(names), key=file_order) == names


def test_writing_tasks_follow_the_bytes(spark):
    assert shard_tasks(spark, 10_000) == 8
    assert shard_tasks(spark, 10_000, 100 << 30) == 400
    assert shard_tasks(spark, 3, 100 << 30) == 3 and shard_tasks(spark, 0) == 1
