import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from models import take_budget
from tokenloom.functions.tokenizers import Utf8ByteTokenizer
from tokenloom.operators.budget import mixture
from tokenloom.streaming.ingest import budgeted_ingest, read_ingested, stream_corpus
from tokenloom.streaming.metrics import live_best, live_log


def write_files(folder, tables):
    """Files one after the other, with rising modification times."""
    os.makedirs(folder, exist_ok=True)
    for i, table in enumerate(tables):
        path = f"{folder}/f{i:03d}.parquet"
        pq.write_table(table, path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_stream_budget_equals_batch_budget(spark, out):
    rng = random.Random(2)
    docs = [(i, rng.choice("AAB"), "é" * rng.randrange(0, 15)) for i in range(90)]
    cut = [docs[:25], docs[25:26], docs[26:60], docs[60:]]
    tables = [
        pa.table({"id": [d[0] for d in part], "src": [d[1] for d in part],
                  "text": [d[2] for d in part], "extra": [0] * len(part)})
        for part in cut
    ]
    write_files(f"{out}/in", tables)
    schema = spark.read.parquet(f"{out}/in").schema
    targets = {"A": 501, "B": 10_000, "C": 3}

    def start():
        source = stream_corpus(spark, f"{out}/in", schema, F.col("src"), F.col("id"), 1)
        drain(budgeted_ingest(source, mixture(spark, targets), Utf8ByteTokenizer(), f"{out}/to",
                              f"{out}/progress"))

    start()
    expected = {
        (s, *row) for s in targets
        for row in take_budget([(i, t) for i, src, t in docs if src == s and t], targets[s])
    }

    def stored():
        rows = read_ingested(spark, f"{out}/to").collect()
        assert len(rows) == len(expected)
        return {(r["source"], r["seq"], r["kept_tokens"], r["text"]) for r in rows}

    assert stored() == expected
    # The last batch again, as after a failure between its output and its commit.
    last = max(os.listdir(f"{out}/progress/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    os.remove(f"{out}/progress/commits/{last}")
    crc = f"{out}/progress/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    start()
    assert stored() == expected


def test_live_metrics(spark, out):
    rows = [("a", 0, 3.0), ("a", 1, 2.0), ("b", 0, 9.0), ("a", 2, 2.0), ("b", 10, 1.0), ("a", 10, 5.0)]
    parts = [rows[:2], rows[2:4], rows[4:]]
    write_files(f"{out}/log", [
        pa.table({"run": [r[0] for r in p], "iter": [r[1] for r in p], "loss": [r[2] for r in p]})
        for p in parts])
    schema = spark.read.parquet(f"{out}/log").schema

    def metrics():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/log")

    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r["run"]] = (number, r["loss"], r["iter"], r["evals"])

    drain(live_best(metrics()).writeStream.outputMode("update").foreachBatch(keep)
          .option("checkpointLocation", f"{out}/p1"))
    assert seen == {"a": (2, 2.0, 1, 4), "b": (2, 1.0, 10, 2)}

    drain(live_log(metrics(), 10).writeStream.format("parquet").option("path", f"{out}/thin")
          .option("checkpointLocation", f"{out}/p2"))
    assert {tuple(r) for r in spark.read.parquet(f"{out}/thin").collect()} == {
        ("a", 0, 3.0), ("b", 0, 9.0), ("b", 10, 1.0), ("a", 10, 5.0)}
