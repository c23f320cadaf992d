import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenloom.functions.tokenizers import Utf8ByteTokenizer
from tokenloom.operators.shards import split_fragments
from tokenloom.sources.corpus import scan_corpus
from tokenloom.sources.metadata import dataset_meta, pass_columns, put_meta, read_meta
from tokenloom.sources.shards import (
    read_raw_shards,
    read_token_shards,
    write_raw_shards,
    write_token_bins,
    write_token_shards,
)
from tokenloom.sources.tokenbin import TokenBinSource


def test_corpus_scan_numbers_rows_in_file_order(spark, out):
    for d, names in {"one": ["b", "a"], "two": ["c"]}.items():
        os.makedirs(f"{out}/{d}")
        for n in names:
            pq.write_table(
                pa.table({"text": [f"{n}{i}" for i in range(3)], "other": [1, 2, 3]}),
                f"{out}/{d}/{n}.parquet",
            )
    docs = scan_corpus(spark, {"X": f"{out}/one", "Y": f"{out}/two"})
    rows = docs.orderBy("source", "seq").collect()
    assert [r["text"] for r in rows] == ["a0", "a1", "a2", "b0", "b1", "b2", "c0", "c1", "c2"]
    assert [r["source"] for r in rows] == ["X"] * 6 + ["Y"] * 3
    assert len({(r["source"], r["seq"]) for r in rows}) == 9
    plan = docs._jdf.queryExecution().toString()
    assert "other" not in plan.split("ReadSchema")[1]


def test_corpus_scan_of_bytes_lists_and_missing_text(spark, out):
    pq.write_table(pa.table({"text": [b"a\xffb", None]}), f"{out}/bytes.parquet")
    pq.write_table(pa.table({"text": [["x", "", "y"], []]}), f"{out}/lists.parquet")
    pq.write_table(pa.table({"body": ["x"]}), f"{out}/missing.parquet")
    names = ("bytes", "lists", "missing")
    docs = scan_corpus(spark, {n: f"{out}/{n}.parquet" for n in names})
    rows = [(r["source"], r["text"]) for r in docs.orderBy("source", "seq").collect()]
    assert rows == [("bytes", "a�b"), ("bytes", None), ("lists", "x y"), ("lists", None),
                    ("missing", None)]


def test_raw_shards_are_one_file_each_and_replaced(spark, out):
    rows = [(i % 5, i // 5, f"text {i}" if i else "") for i in range(40)]
    docs = spark.createDataFrame(rows, "shard_id long, pos long, text string").repartition(6)
    path = f"{out}/raw"
    for frame, shards in ((docs.unionByName(docs.withColumn("shard_id", F.col("shard_id") + 5)), 10),
                          (docs, 5)):
        write_raw_shards(frame, path, shards)
        folders = sorted(d for d in os.listdir(path) if d.startswith("shard_id="))
        assert len(folders) == shards
        for folder in folders:
            files = [f for f in os.listdir(f"{path}/{folder}") if f.endswith(".parquet")]
            assert len(files) == 1
            stored = pq.ParquetFile(f"{path}/{folder}/{files[0]}").read(["pos"])["pos"].to_pylist()
            assert stored == sorted(stored)
    back = {(r["shard_id"], r["pos"], r["text"]) for r in read_raw_shards(spark, path).collect()}
    assert back == {r for r in rows if r[2]}


def test_missing_shards_are_an_error(spark, out):
    write_raw_shards(spark.createDataFrame([], "shard_id long, pos long, text string"), f"{out}/none", 0)
    assert not os.path.exists(f"{out}/none")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_raw_shards(spark, f"{out}/none")
    spark.dataSource.register(TokenBinSource)
    with pytest.raises(Exception, match="no .bin files"):
        spark.read.format("tokenbin").load(f"{out}/none").count()


def fragments(spark, sizes, val, limit):
    rows, at = [], 0
    for n in sizes:
        rows.append((at, at + n, [(i * 37) % 50_257 for i in range(at, at + n)]))
        at += n
    docs = spark.createDataFrame(rows, "start long, end long, tokens array<int>").repartition(5)
    return split_fragments(docs, val, limit), [(i * 37) % 50_257 for i in range(at)]


@pytest.mark.parametrize("val", [0, 70])
def test_token_files_round_trip(spark, out, val):
    spark.dataSource.register(TokenBinSource)
    cut, ids = fragments(spark, [30, 250, 1, 99, 500, 20, 7], val, 100)
    count = -(-(len(ids) - val) // 100)
    # A longer earlier export, which must leave no file behind.
    earlier, _ = fragments(spark, [2000], 5, 100)
    write_token_bins(earlier, f"{out}/bins", 20)
    write_token_shards(cut, f"{out}/tokens", count)
    write_token_bins(read_token_shards(spark, f"{out}/tokens"), f"{out}/bins", count)

    names = sorted(os.listdir(f"{out}/bins/train_shards"))
    assert names == [f"shard_{i:05d}.bin" for i in range(count)]
    assert os.path.exists(f"{out}/bins/val.bin") == (val > 0)
    flat = np.concatenate([np.fromfile(f"{out}/bins/train_shards/{n}", "<u2") for n in names])
    assert flat.tolist() == ids[val:]
    sizes = [os.path.getsize(f"{out}/bins/train_shards/{n}") for n in names]
    assert all(s == 200 for s in sizes[:-1]) and 0 < sizes[-1] <= 200

    for per_row, per_task in ((33, 64), (1_000, 1_000), (65_536, 150)):
        rows = (
            spark.read.format("tokenbin")
            .option("rowTokens", per_row)
            .option("partitionTokens", per_task)
            .load(f"{out}/bins/train_shards")
            .orderBy("start")
            .collect()
        )
        at = 0
        for r in rows:
            assert r["start"] == at and r["end"] == at + len(r["tokens"])
            at = r["end"]
        assert [t for r in rows for t in r["tokens"]] == ids[val:]
    if val:
        only = spark.read.format("tokenbin").load(f"{out}/bins/val.bin").first()
        assert only["tokens"] == ids[:val]


def test_ids_beyond_16_bits_are_refused(spark, out):
    spark.dataSource.register(TokenBinSource)
    df = spark.createDataFrame([("train", 0, 0, 1, [70_000])],
                               "split string, shard_id long, start long, end long, tokens array<int>")
    with pytest.raises(Exception, match="does not fit 16 bits"):
        write_token_bins(df, f"{out}/bins", 1)
    assert not [f for f in os.listdir(f"{out}/bins/train_shards") if f.endswith(".bin")]


def test_token_shards_prune_by_split(spark, out):
    cut, ids = fragments(spark, [30, 250], 70, 100)
    write_token_shards(cut, f"{out}/tokens", 3)
    val = read_token_shards(spark, f"{out}/tokens", "val")
    assert [t for r in val.orderBy("start").collect() for t in r["tokens"]] == ids[:70]
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().toString()


def test_metadata_rows(spark, out):
    cut, ids = fragments(spark, [30, 250, 700], 70, 100)
    meta = dataset_meta(cut, Utf8ByteTokenizer(), 100)
    put_meta(meta, f"{out}/meta", "v1")
    put_meta(meta.withColumn("vocab_size", F.lit(None).cast("long")), f"{out}/meta", "v2")
    rows = {r["version"]: r.asDict() for r in read_meta(spark, f"{out}/meta").collect()}
    assert rows["v2"]["vocab_size"] == 50_257
    assert {k: rows["v1"][k] for k in ("train_tokens", "val_tokens", "num_train_shards",
                                       "bin_shard_tokens", "count_separator_token", "tokenizer",
                                       "vocab_size")} == {
        "train_tokens": 910, "val_tokens": 70, "num_train_shards": 10, "bin_shard_tokens": 100,
        "count_separator_token": True, "tokenizer": "utf8_byte", "vocab_size": 257}
    full = pass_columns(meta, block=1024, world=8, batch=16, accum=1)
    big = full.withColumn("train_tokens", F.lit(998_361_600)).select(
        F.expr("train_tokens div tokens_per_iter")).first()[0]
    assert big == 7_616
