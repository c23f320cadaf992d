import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from models import byte_ids, pack, shuffle, take_budget
from tokenloom.functions.tokenizers import Utf8ByteTokenizer
from tokenloom.operators.budget import mixture
from tokenloom.operators.shards import holdout_size
from tokenloom.plans.prepare import prepare
from tokenloom.sources.metadata import read_meta
from tokenloom.sources.shards import read_token_shards

TARGETS = {"A": 3_000, "B": 1_801, "C": 1_000, "D": 50}


def corpus():
    docs = {}
    for k, source in enumerate("ABCX"):
        docs[source] = [
            (i * 3 + k, ("né€" * ((i * 7 + k) % 23) + source)[: 1 + (i * 5) % 60] if i % 9 else "")
            for i in range(120)
        ]
    docs["B"][4] = (docs["B"][4][0], "y" * 700)
    return docs


def expected(docs, seed, raw_limit):
    kept = []
    for source in TARGETS:
        nonempty = [d for d in docs.get(source, []) if d[1]]
        kept += [(source, *row) for row in take_budget(nonempty, TARGETS[source])]
    ordered = shuffle(kept, seed)
    shards = pack([n for _, _, n, _ in ordered], raw_limit)
    stream = [i for _, _, _, text in ordered if text for i in byte_ids(text)]
    return ordered, shards, stream


def test_the_whole_job(spark, out):
    docs = corpus()
    rows = [(s, q, t) for s, items in docs.items() for q, t in items]
    df = spark.createDataFrame(rows, "source string, seq long, text string").repartition(5)
    df.write.parquet(f"{out}/in")
    done = prepare(
        spark.read.parquet(f"{out}/in"), mixture(spark, TARGETS), Utf8ByteTokenizer(), out,
        raw_limit=400, token_limit=500, val_cap=163,
    )
    ordered, shards, stream = expected(docs, 42, 400)

    assert done.raw_shards == shards[-1] + 1
    found = []
    for shard in range(done.raw_shards):
        files = glob.glob(f"{done.raw_path}/shard_id={shard}/*.parquet")
        assert len(files) == 1
        found += [(shard, t) for t in pq.ParquetFile(files[0]).read(["text"])["text"].to_pylist()]
    assert found == [(s, row[3]) for s, row in zip(shards, ordered)]

    val = holdout_size(len(stream), 163)
    tokens = {"val": [], "train": []}
    for r in read_token_shards(spark, done.token_path).orderBy("split", "start").collect():
        assert r["start"] == len(tokens[r["split"]])
        tokens[r["split"]] += r["tokens"]
    assert tokens == {"val": stream[:val], "train": stream[val:]}
    assert done.train_shards == -(-(len(stream) - val) // 500)

    meta = read_meta(spark, done.meta_path).first()
    assert (meta["train_tokens"], meta["val_tokens"]) == (len(stream) - val, val)
    assert meta["num_train_shards"] == done.train_shards
    report = {r["source"]: r["written_tokens"] for r in done.report.collect()}
    assert report == {s: sum(n for t, _, n, _ in ordered if t == s) for s in TARGETS}
    skipped = {(r["source"], r["reason"]): r["docs"] for r in done.skipped.collect()}
    last = max(q for s, q, *_ in ordered if s == "A")
    read = [t for q, t in docs["A"] if q <= last or report["A"] < TARGETS["A"]]
    assert skipped["A", "empty"] == sum(1 for t in read if not t)


def test_nothing_to_take_is_an_error(spark, out):
    df = spark.createDataFrame([("A", 1, "")], "source string, seq long, text string")
    with pytest.raises(ValueError, match="no documents"):
        prepare(df, mixture(spark, {"A": 5}), Utf8ByteTokenizer(), out)
