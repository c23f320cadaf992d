"""Ids made where they are written, windows cut where they are read, draws among ties, late rows."""

import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from models import byte_ids, read_windows
from test_streaming import drain, write_files
from tokenloom.functions.tokenizers import Utf8ByteTokenizer
from tokenloom.operators.budget import mixture
from tokenloom.operators.runlog import topk_draw
from tokenloom.operators.windows import RankPlan, edge_pieces, stored_windows
from tokenloom.session import materialize
from tokenloom.sources.shards import (
    encode_in_place,
    read_token_shards,
    write_encoded_bins,
    write_encoded_shards,
)
from tokenloom.sources.tokenbin import TokenBinSource
from tokenloom.streaming.ingest import (
    budgeted_ingest,
    read_ingested,
    read_late,
    read_skips,
    stream_corpus,
)

TOKENIZER = Utf8ByteTokenizer()


def text_stream(spark, sizes):
    rows, ids = [], []
    for i, n in enumerate(sizes):
        text = (f"{i}é" * n)[:n]
        own = byte_ids(text)
        rows.append((len(ids), len(ids) + len(own), text))
        ids += own
    rows.append((5, 5, "no ids"))
    return spark.createDataFrame(rows, "start long, end long, text string").repartition(5), ids


@pytest.mark.parametrize("val,limit", [(0, 100), (70, 100), (70, 7), (5, 10**6)])
def test_ids_are_made_in_the_task_that_writes_them(spark, out, val, limit):
    stream, ids = text_stream(spark, [30, 250, 1, 99, 700, 20, 7])
    stream = materialize(stream, "s")
    made = encode_in_place(stream, TOKENIZER, val, limit, len(ids))
    write_encoded_shards(made, f"{out}/tokens")
    spark.dataSource.register(TokenBinSource)
    write_encoded_bins(made, f"{out}/bins")
    held = {"val": [], "train": []}
    for r in read_token_shards(spark, f"{out}/tokens").orderBy("split", "start").collect():
        assert r["start"] == len(held[r["split"]]) and r["shard_id"] == (
            0 if r["split"] == "val" else r["start"] // limit)
        held[r["split"]] += r["tokens"]
    assert held == {"val": ids[:val], "train": ids[val:]}
    names = sorted(os.listdir(f"{out}/bins/train_shards"))
    assert len(names) == -(-(len(ids) - val) // limit)
    flat = spark.read.format("tokenbin").load(f"{out}/bins/train_shards").orderBy("start").collect()
    assert [t for r in flat for t in r["tokens"]] == ids[val:]
    # Text alone is shuffled: the ids are made above the only exchange.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")


def test_ids_must_fill_the_positions(spark):
    class Wrong(Utf8ByteTokenizer):
        def encode(self, text):
            return F.array(F.lit(1))

    stream, ids = text_stream(spark, [9])
    with pytest.raises(Exception, match="do not fill"):
        encode_in_place(stream, Wrong(), 0, 10, len(ids)).collect()


@pytest.mark.parametrize("world,block", [(1, 8), (3, 16), (2, 208)])
def test_stored_windows(spark, world, block):
    rng = random.Random(5)
    ids = [rng.randrange(257) for _ in range(2_000)]
    rows = [(a, min(a + 500, 2_000), ids[a : a + 500]) for a in range(0, 2_000, 500)]
    stream = spark.createDataFrame(rows, "start long, end long, tokens array<int>")
    plan = RankPlan(len(ids), world, block)
    found = {(r["rank"], r["window"]): r["tokens"] for r in stored_windows(stream, plan).collect()}
    per = plan.windows_per_rank
    assert len(found) == world * per
    for rank in range(world):
        assert [found[rank, w] for w in range(per)] == read_windows(ids, world, rank, block, per)
    moved = edge_pieces(stream, plan).agg(F.sum(F.size("piece"))).first()[0] or 0
    if block == 16:
        assert moved < 0.1 * len(ids)


@pytest.mark.parametrize("kind,max_rows", [("long", 10**6), ("long", 40), ("string", 10**6)])
def test_a_draw_among_many_ties(spark, kind, max_rows):
    rows = [("a", i, 2.0) for i in range(300)] + [("a", 900, 3.0), ("a", 901, 1.0), ("b", 1, 0.5)]
    df = spark.createDataFrame(rows, "k string, item long, score double")
    df = df.withColumn("item", F.col("item").cast(kind))
    order = sorted((str(i) if kind == "string" else i) for i in range(300))
    weights = [math.exp(1.0)] + [1.0] * 300
    for u in (0.0, 0.001, 0.25, 0.5, 0.999):
        got = {r["k"]: r for r in topk_draw(df, "k", "item", 2, 1.0, F.lit(u), max_rows).collect()}
        goal, run = u * sum(weights), 0.0
        for place, w in enumerate(weights):
            run += w
            if run > goal:
                break
        want = "900" if kind == "string" else 900
        assert got["a"]["item"] == (want if place == 0 else order[place - 1])
        assert got["a"]["candidates"] == 301 and got["b"]["candidates"] == 1
        assert got["a"]["probability"] == pytest.approx(weights[place] / sum(weights))


def test_the_stream_goes_on_after_late_documents(spark, out):
    docs = [("A", i, "x" * (i % 5)) for i in range(40)]
    parts = [docs[:10], docs[10:30], [("A", 4, "late"), ("A", None, "lost"), ("B", 1, "b")], docs[30:]]
    write_files(f"{out}/in", [
        pa.table({"src": [d[0] for d in p], "id": pa.array([d[1] for d in p], pa.int64()),
                  "text": [d[2] for d in p]}) for p in parts])
    schema = spark.read.parquet(f"{out}/in").schema
    source = stream_corpus(spark, f"{out}/in", schema, F.col("src"), F.col("id"), 1)
    spec = mixture(spark, {"A": 10_000, "B": 10_000})
    drain(budgeted_ingest(source, spec, TOKENIZER, f"{out}/to", f"{out}/progress"))
    kept = {(r["source"], r["seq"]) for r in read_ingested(spark, f"{out}/to").collect()}
    assert kept == {(s, i) for s, i, t in docs if t} | {("B", 1)}
    late = {(r["seq"], r["text"]) for r in read_late(spark, f"{out}/to").collect()}
    assert late == {(4, "late"), (None, "lost")}
    skips = {(r["source"], r["reason"]): r["docs"] for r in read_skips(spark, f"{out}/to").collect()}
    assert skips == {("A", "kept"): 32, ("A", "empty"): 8, ("A", "late"): 2, ("B", "kept"): 1}


def test_the_ledger_stays_short(spark, out):
    tables = [pa.table({"src": ["A"], "id": [i], "text": ["ab"]}) for i in range(12)]
    write_files(f"{out}/in", tables)
    schema = spark.read.parquet(f"{out}/in").schema
    source = stream_corpus(spark, f"{out}/in", schema, F.col("src"), F.col("id"), 1)
    spec = mixture(spark, {"A": 1_000})
    drain(budgeted_ingest(source, spec, TOKENIZER, f"{out}/to", f"{out}/progress"))
    assert sorted(os.listdir(f"{out}/to/ledger")) == ["batch_id=10", "batch_id=11"]
    entry = spark.read.parquet(f"{out}/to/ledger/batch_id=11").first()
    assert (entry["written_tokens"], entry["last_seq"]) == (36, 11)
