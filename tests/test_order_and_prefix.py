import random

import pytest
from pyspark.sql import functions as F

from models import shuffle
from tokenloom.functions.keys import key_bucket, keyed_draw
from tokenloom.operators.lookup import interval_lookup
from tokenloom.operators.order import global_shuffle, stream_positions, with_shuffle_key
from tokenloom.operators.prefix import grouped_running, order_bins

ROWS = [(s, q, 1 + (q * 7) % 13) for s in "AB" for q in range(150)]
SCHEMA = "source string, seq long, n_tokens long"


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_shuffle_is_total_and_repeatable(spark, partitions):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(partitions)
    rows = global_shuffle(df, 42, partitions=partitions).collect()
    assert [(r["source"], r["seq"]) for r in rows] == [(s, q) for s, q, _ in shuffle(ROWS, 42)]


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_positions_tile_the_stream(spark, buckets):
    df = with_shuffle_key(spark.createDataFrame(ROWS, SCHEMA).repartition(5), 42)
    rows = stream_positions(df, buckets=buckets).orderBy("pos").collect()
    at = 0
    for i, (row, (source, seq, n)) in enumerate(zip(rows, shuffle(ROWS, 42), strict=True)):
        assert (row["pos"], row["source"], row["seq"]) == (i, source, seq)
        assert (row["start"], row["end"]) == (at, at + n)
        at += n


def test_buckets_follow_the_keys(spark):
    df = with_shuffle_key(spark.createDataFrame(ROWS, SCHEMA), 1)
    rows = df.select("key", key_bucket(F.col("key"), 10).alias("b")).orderBy("key").collect()
    numbers = [r["b"] for r in rows]
    assert numbers == sorted(numbers) and set(numbers) == set(range(10))


def test_draws_are_keyed(spark):
    df = spark.range(1000).select(keyed_draw(17, F.lit("x"), F.col("id")).alias("d"))
    first = [r["d"] for r in df.collect()]
    again = [r["d"] for r in df.repartition(3).sort("d").collect()]
    assert sorted(first) == again and set(first) == set(range(17))


def skewed_log():
    """One run holds a third of all rows, in two dense stretches far apart."""
    rng = random.Random(3)
    rows = [("hot", i if i < 70 else (1 << 40) + i, rng.random()) for i in range(140)]
    rows += [(f"r{i % 40}", i, rng.random()) for i in range(280)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("max_rows", [4_000_000, 50, 10, 1])
def test_running_values_of_hot_groups(spark, max_rows):
    rows = skewed_log()
    df = spark.createDataFrame(rows, "run string, iter long, loss double").repartition(4)
    found = grouped_running(
        df,
        ["run"],
        "iter",
        ["iter"],
        sums={"n": F.lit(1).cast("long")},
        mins={"low": F.col("loss")},
        lags={"last": F.col("iter")},
        max_rows=max_rows,
    )
    seen = {(r["run"], r["iter"]): (r["n"], r["low"], r["last"]) for r in found.collect()}
    assert len(seen) == len(rows)
    state = {}
    for run, it, loss in sorted(rows):
        n, low, last = state.get(run, (0, None, None))
        assert seen[run, it] == (n, low, last)
        state[run] = (n + 1, loss if low is None else min(low, loss), it)


def test_hot_groups_are_cut_to_the_bound(spark):
    df = spark.createDataFrame(skewed_log(), "run string, iter long, loss double")
    binned, cuts = order_bins(df, ["run"], "iter", max_rows=10)
    sizes = binned.groupBy("run", "_bin").count().agg(F.max("count")).first()[0]
    assert cuts > 0 and sizes <= 10
    _, none = order_bins(df, ["run"], "iter", max_rows=1000)
    assert none == 0


def test_lookup_in_intervals_of_any_length(spark):
    edges = [0, 3, 4, 90, 91, 1000, 1001]
    table = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    intervals = spark.createDataFrame(table, "shard_id long, low long, high long")
    points = spark.range(1001).withColumnRenamed("id", "p")
    for rows in (len(table), 10_000_000):
        found = interval_lookup(points, intervals, "p", "low", "high", 50, rows, ["shard_id"])
        got = {r["p"]: r["shard_id"] for r in found.collect()}
        assert got == {p: i for i, lo, hi in table for p in range(lo, hi)}


def physical(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_no_single_task_under_a_row_window(spark):
    """Only the bucket table, already aggregated, meets in one task."""
    df = with_shuffle_key(spark.createDataFrame(ROWS, SCHEMA), 42)
    plan = physical(stream_positions(df))
    for part in plan.split("Exchange SinglePartition")[1:]:
        below = part.lstrip().split("\n", 2)[1]
        assert "HashAggregate" in below
    shuffled = physical(global_shuffle(spark.createDataFrame(ROWS, SCHEMA), 42))
    assert "rangepartitioning" not in shuffled and "SinglePartition" not in shuffled
