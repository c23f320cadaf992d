"""Exports of token files: what readers see when a commit is cut short, and what the next one does."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.sources import tokenbin
from tokenloom.sources.shards import read_token_bins, write_token_bins
from tokenloom.sources.tokenbin import TokenBinReader, TokenBinSource, TokenBinWriter

SCHEMA = pa.schema([("split", pa.string()), ("shard_id", pa.int64()), ("start", pa.int64()),
                    ("tokens", pa.list_(pa.int32()))])


class Crash(Exception):
    pass


def write(root, shards, overwrite=True, first=0):
    """Two tasks write the shards given as lists of ids."""
    writer = TokenBinWriter({"path": root}, overwrite)
    rows = [("train", first + i, 0, ids) for i, ids in enumerate(shards)]
    messages = []
    for part in (rows[::2], rows[1::2]):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*part), SCHEMA)] if part else []
        batches = [pa.RecordBatch.from_arrays(columns, schema=SCHEMA)] if part else []
        messages.append(writer.write(iter(batches)))
    return writer, messages


def held(root):
    reader = TokenBinReader({"path": f"{root}/train_shards", "rowTokens": 3})
    rows = [b.to_pylist()[0] for part in reader.partitions() for b in reader.read(part)]
    assert [r["start"] for r in rows] == [0, *np.cumsum([len(r["tokens"]) for r in rows])][:-1]
    return [i for r in rows for i in r["tokens"]]


def names(root):
    return sorted(os.listdir(f"{root}/train_shards"))


OLD = [[1, 2, 3, 4, 5], [6, 7], [8, 9, 10, 11]]
NEW = [[50] * 4, [51] * 9]


class Broken:
    """A file system that fails at its n-th move or deletion."""

    def __init__(self, system, steps):
        self.system, self.steps = system, steps

    def __getattr__(self, name):
        if name in ("move", "delete_file"):
            if not self.steps:
                raise Crash
            self.steps -= 1
        return getattr(self.system, name)


@pytest.mark.parametrize("steps", range(9))
def test_a_commit_cut_short_leaves_one_whole_export(out, monkeypatch, steps):
    writer, messages = write(out, OLD)
    writer.commit(messages)
    assert names(out) == [f"shard_{i:05d}.bin" for i in range(3)]
    writer, messages = write(out, NEW)
    # Before the commit nothing has changed, and the files in writing are not read.
    assert held(out) == sum(OLD, [])
    plain = tokenbin._open

    def broken(path, _systems={}):
        system, root = plain(path)
        return _systems.setdefault("one", Broken(system, steps)), root

    monkeypatch.setattr(tokenbin, "_open", broken)
    try:
        writer.commit(messages)
        cut = False
    except Crash:
        cut = True
    monkeypatch.setattr(tokenbin, "_open", plain)
    assert cut == (steps < 8)
    # The first step puts the list in place; from then on the new export is read.
    assert held(out) == sum(OLD if steps == 0 else NEW, [])
    one = TokenBinReader({"path": f"{out}/train_shards/shard_00001.bin"})
    (part,) = one.partitions()
    ids = [i for batch in one.read(part) for i in batch.to_pylist()[0]["tokens"]]
    assert ids == (OLD if steps == 0 else NEW)[1]
    # The next export is whole whatever was left, with fewer shards and no file of the others.
    writer, messages = write(out, [[7, 7, 7]])
    writer.commit(messages)
    assert held(out) == [7, 7, 7] and names(out) == ["shard_00000.bin"]
    assert sorted(os.listdir(out)) == ["_manifest.json", "train_shards"]


def test_failed_tasks_leave_nothing_behind(out):
    write(out, OLD)
    writer, messages = write(out, NEW)
    writer.commit(messages)
    assert names(out) == ["shard_00000.bin", "shard_00001.bin"] and held(out) == sum(NEW, [])


def test_an_append_keeps_what_it_does_not_replace(out):
    for shards, first in ((OLD, 0), ([[90], [91, 92]], 2)):
        writer, messages = write(out, shards, overwrite=False, first=first)
        writer.commit(messages)
    assert held(out) == [1, 2, 3, 4, 5, 6, 7, 90, 91, 92]


def test_files_that_no_list_names_are_not_read(out):
    writer, messages = write(out, OLD)
    writer.commit(messages)
    np.array([3, 3], "<u2").tofile(f"{out}/train_shards/shard_00009.bin")
    assert held(out) == sum(OLD, [])
    np.array([3, 3], "<u2").tofile(f"{out}/train_shards/shard_00000.bin")
    with pytest.raises(ValueError, match="is not the file of 10 bytes"):
        held(out)
    # Without a list a folder is read as it is.
    os.rename(f"{out}/_manifest.json", f"{out}/old.json")
    assert held(out) == [3, 3, 6, 7, 8, 9, 10, 11, 3, 3]


def test_the_manifest_of_a_job(spark, out):
    spark.dataSource.register(TokenBinSource)
    rows = [("val", 0, 0, [1, 2]), ("train", 0, 0, [3, 4, 5]), ("train", 1, 3, [6])]
    df = spark.createDataFrame(rows, "split string, shard_id long, start long, tokens array<int>")
    df = df.withColumn("end", F.col("start") + F.size("tokens"))
    write_token_bins(df, f"{out}/bins", 2)
    with open(f"{out}/bins/_manifest.json") as file:
        sizes = {name: size for name, _, size in json.load(file)}
    shard = tokenbin.TRAIN_NAME.format
    assert sizes == {"val.bin": 4, shard(0): 6, shard(1): 2}
    found = read_token_bins(spark, f"{out}/bins/train_shards", rowTokens=2).orderBy("start")
    assert [r["tokens"] for r in found.collect()] == [[3, 4], [5], [6]]
    assert [r["tokens"] for r in read_token_bins(spark, f"{out}/bins").collect()] == [[1, 2]]
