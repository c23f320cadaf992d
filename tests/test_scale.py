"""Work that must not grow with the table: blocks in workers, files of a stream, splits of a scan."""

import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from models import byte_ids, take_budget
from tokenloom.functions import tokenizers
from tokenloom.functions.tokenizers import ExternalTokenizer, Utf8ByteTokenizer
from tokenloom.operators.windows import stack_random_batches
from tokenloom.plans import queries
from tokenloom.session import shared_dir


def long_texts(n=60):
    rng = random.Random(4)
    texts = [None, "", *["é" * rng.randrange(0, 60_000) for _ in range(n)], "x" * 3_000_000, None, "a"]
    return texts


@pytest.mark.parametrize("offset", [0, 5])
def test_workers_hold_the_ids_of_a_block(offset):
    texts = long_texts()
    batch = pa.array(texts, pa.string()).slice(offset)
    seen = []

    def work(block):
        seen.append([len(t.encode()) for t in block.to_pylist() if t])
        return tokenizers._byte_ids(block, 256)

    made = list(tokenizers._in_blocks(iter([batch, batch.slice(0, 0)]), work))
    found = [ids for block in made for ids in block.to_pylist()]
    assert found == [None if t is None else byte_ids(t) for t in texts[offset:]]
    assert len(seen) > 3
    assert all(len(sizes) == 1 or sum(sizes) <= tokenizers.BLOCK_BYTES for sizes in seen)
    # And back, block by block of ids.
    ids = pa.array(found, pa.list_(pa.int32()))
    back = tokenizers._id_bytes(ids, 256).to_pylist()
    parts = tokenizers._in_blocks(iter([ids]), lambda b: tokenizers._id_bytes(b, 256), 4)
    assert [row for part in parts for row in part.to_pylist()] == back


def bytes_loader():
    """Loader of an encoder whose ids are bytes."""

    def load():
        class Bytes:
            def encode(self, text):
                return list(text.encode())

            def decode(self, ids):
                return bytes(ids).decode()

        return Bytes()

    return load


@pytest.mark.parametrize("external", [False, True])
def test_long_texts_through_the_tokenizers(spark, external):
    tok = ExternalTokenizer("b", bytes_loader(), 257, 256) if external else Utf8ByteTokenizer()
    texts = long_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    made = df.withColumn("ids", tok.encode(F.col("text")))
    rows = made.select("i", "ids", tok.count(F.col("text")).alias("n"), tok.decode(F.col("ids")).alias("t"))
    for r in rows.toLocalIterator():
        text = texts[r["i"]]
        assert r["ids"] == (None if text is None else byte_ids(text))
        assert r["n"] == (None if text is None else len(r["ids"]))
        assert r["t"] == (text or "")


def test_external_encoders_work_block_by_block():
    tok = ExternalTokenizer("b", bytes_loader(), 257, 256)
    blocks = tokenizers._in_blocks(
        iter([pa.array(long_texts(), pa.string())]),
        lambda texts: pa.array([sum(map(len, filter(None, tok._block(texts))))] * len(texts)),
    )
    assert len([b for b in blocks if len(b)]) > 3


def documents(folder, rows, files):
    """``rows`` as a ``documents`` table of several files, each with rows of all the table."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    (folder / "documents.parquet").mkdir()
    for k in range(files):
        columns = zip(*rows[k::files])
        table = pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)
        pq.write_table(table, folder / f"documents.parquet/{k}.parquet")


def test_a_delivery_of_the_stream_is_written_by_many_tasks(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "z" * rng.randrange(1, 2_000), "en", f"src{i % 20}", 0) for i in range(400)]
    rows += [(None, "no place", "en", "src3", 0)]
    rng.shuffle(rows)
    documents(tmp_path, rows, 6)
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tokenloom/arriving-*"))
    found = queries.QUERIES["streamed_budget"](spark, str(tmp_path)).collect()
    after = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tokenloom/arriving-*"))
    (folder,) = after - before
    assert len(glob.glob(f"{folder}/*.parquet")) > 4
    source = lambda s: "A" if int(s[3:]) < 10 else "B" if int(s[3:]) < 16 else "C"
    expected = set()
    for name, each in {"A": 500, "B": 300, "C": 200}.items():
        own = [(r[0], r[1]) for r in rows if r[0] is not None and source(r[3]) == name]
        expected |= {(name, q, n) for q, n, _ in take_budget(own, each * len(rows))}
    assert {(r["source"], r["seq"], r["kept_tokens"]) for r in found} == expected
    skips = queries.QUERIES["streamed_skips"](spark, str(tmp_path)).collect()
    assert [r["docs"] for r in skips if r["reason"] == "late"] == [1]


def test_splits_of_a_scan_do_not_grow_in_number(spark, tmp_path):
    for k in range(8):
        with open(tmp_path / f"part-{k}.json", "wb") as file:
            file.truncate(32 << 20)
    session = queries._small_splits(spark, str(tmp_path))
    splits = session.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert 8 * 32 < splits <= 8 * 65


def test_ids_are_widened_outside_of_functions_over_slots(spark):
    rows = [(0, 1, [1, 2, 3]), (0, 0, [7, 8, 9]), (1, 0, [4, 5, 6])]
    windows = spark.createDataFrame(rows, "step long, slot long, tokens array<int>")
    stacked = stack_random_batches(windows, 2)
    plan = stacked._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and stacked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = {r["step"]: (r["x"], r["y"]) for r in stacked.collect()}
    assert found == {0: ([[7, 8], [1, 2]], [[8, 9], [2, 3]]), 1: ([[4, 5]], [[5, 6]])}
