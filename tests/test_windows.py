import random

import pytest

from models import read_windows
from tokenloom.operators.shards import shard_table
from tokenloom.operators.windows import (
    RankPlan,
    assemble_batches,
    batch_schedule,
    epoch_schedule,
    next_token_pairs,
    rank_ranges,
    sequential_windows,
    stack_random_batches,
    train_draws,
    val_draws,
    windows_at,
)


def stream(spark, sizes):
    rng = random.Random(5)
    ids = [rng.randrange(257) for _ in range(sum(sizes))]
    rows, at = [], 0
    for n in sizes:
        rows.append((at, at + n, ids[at : at + n]))
        at += n
    df = spark.createDataFrame(rows, "start long, end long, tokens array<int>")
    return df.repartition(4), ids


SIZES = [1, 40, 3, 2, 95, 7, 1, 1, 60, 8, 13, 150, 4, 33]


@pytest.mark.parametrize("world,block", [(1, 8), (8, 8), (7, 5), (3, 64), (2, 208)])
def test_sequential_windows(spark, world, block):
    df, ids = stream(spark, SIZES)
    plan = RankPlan(len(ids), world, block)
    found = sequential_windows(df, plan)
    seen = {(r["rank"], r["window"]): r["tokens"] for r in found.collect()}
    per = plan.windows_per_rank
    assert len(seen) == world * per
    for rank in range(world):
        expected = read_windows(ids, world, rank, block, per)
        assert [seen[rank, w] for w in range(per)] == expected
    pairs = next_token_pairs(found, block).first()
    assert len(pairs["x"]) == block and pairs["x"][1:] == pairs["y"][:-1]


def test_rank_ranges_drop_the_remainder(spark):
    rows = [tuple(r) for r in rank_ranges(spark, RankPlan(103, 4, 8)).orderBy("rank").collect()]
    assert rows == [(0, 0, 25, 3), (1, 25, 50, 3), (2, 50, 75, 3), (3, 75, 100, 3)]


def test_ranks_too_short_for_a_window_are_refused():
    assert RankPlan(72, 8, 8).windows_per_rank == 1
    with pytest.raises(ValueError, match="do not hold one window"):
        RankPlan(71, 8, 8)


def test_schedules_follow_the_moving_pointer(spark):
    _, ids = stream(spark, SIZES)
    plan = RankPlan(len(ids), 2, 16)
    windows = {}
    for rank in range(2):
        per = plan.windows_per_rank
        order = read_windows(ids, 2, rank, 16, per)
        read = read_windows(ids, 2, rank, 16, 40)
        windows |= {(rank, k): order.index(w) for k, w in enumerate(read)}
    got = {(r["rank"], r["draw"]): r["window"] for r in epoch_schedule(spark, plan, 40).collect()}
    assert got == windows
    batches = batch_schedule(spark, plan, steps=5, accum=2, batch=4).collect()
    assert len(batches) == 80
    for r in batches:
        assert r["draw"] == (r["step"] * 2 + r["micro"]) * 4 + r["slot"]
        assert r["window"] == windows[r["rank"], r["draw"]]


def test_batches_hold_the_scheduled_windows(spark):
    df, ids = stream(spark, SIZES)
    plan = RankPlan(len(ids), 3, 16)
    rows = assemble_batches(df, plan, steps=3, accum=2, batch=4).collect()
    assert len(rows) == 3 * 3 * 2
    for r in rows:
        read = read_windows(ids, 3, r["rank"], 16, 24)
        first = (r["step"] * 2 + r["micro"]) * 4
        assert r["x"] == [w[:-1] for w in read[first : first + 4]]
        assert r["y"] == [w[1:] for w in read[first : first + 4]]
    assert dict(assemble_batches(df, plan, 1, 1, 1).dtypes)["x"] == "array<array<bigint>>"


def test_batches_are_built_behind_one_shuffle(spark):
    df, ids = stream(spark, SIZES)
    from tokenloom.session import materialize

    stored = materialize(df, "t")
    batches = assemble_batches(stored, RankPlan(len(ids), 3, 16), 3, 2, 4)
    assert batches._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("rows", [60, 10_000_000])
def test_random_windows(spark, rows):
    df, ids = stream(spark, SIZES)
    draws = val_draws(spark, 42, steps=15, batch=4, val_tokens=len(ids), block=16)
    found = windows_at(df, draws, 16, rows).collect()
    assert len(found) == 60
    for r in found:
        assert 0 <= r["start"] < len(ids) - 16
        assert r["tokens"] == ids[r["start"] : r["start"] + 17]
    stacked = {r["step"]: r for r in stack_random_batches(windows_at(df, draws, 16, rows), 16).collect()}
    by_slot = sorted((r["slot"], r["tokens"]) for r in found if r["step"] == 3)
    assert stacked[3]["x"] == [t[:-1] for _, t in by_slot]
    assert stacked[3]["y"] == [t[1:] for _, t in by_slot]


def test_train_windows_stay_inside_their_shard(spark):
    _, ids = stream(spark, SIZES)
    shards = shard_table(spark, len(ids), 60)
    draws = train_draws(spark, 42, 40, 5, shards, 60, 16).collect()
    assert len(draws) == 200 and any(r["clamped"] for r in draws)
    for r in draws:
        low, high = r["shard_id"] * 60, min((r["shard_id"] + 1) * 60, len(ids))
        assert low <= r["drawn"] < high and 0 <= r["drawn"] < len(ids) - 17
        assert r["start"] == min(r["drawn"], high - 17)
        assert r["clamped"] == (r["drawn"] > high - 17)


def test_short_shards_are_refused(spark):
    with pytest.raises(ValueError, match="every shard"):
        train_draws(spark, 42, 1, 1, shard_table(spark, 70, 60), 60, 16)
    with pytest.raises(ValueError, match="too short"):
        val_draws(spark, 42, 1, 1, 16, 16)


def test_windows_over_token_files(spark, tmp_path):
    """Windows span files: the flat files of a stream give the windows of the stream."""
    from tokenloom.operators.shards import split_fragments
    from tokenloom.sources.shards import write_token_bins
    from tokenloom.sources.tokenbin import TokenBinSource

    spark.dataSource.register(TokenBinSource)
    df, ids = stream(spark, SIZES)
    write_token_bins(split_fragments(df, 20, 50), f"{tmp_path}/bins", -(-(len(ids) - 20) // 50))
    reader = spark.read.format("tokenbin").option("rowTokens", 30)
    files = reader.load(f"{tmp_path}/bins/train_shards")
    found = sequential_windows(files, RankPlan(len(ids) - 20, 2, 64)).collect()
    seen = {(r["rank"], r["window"]): r["tokens"] for r in found}
    for rank in range(2):
        expected = read_windows(ids[20:], 2, rank, 64, len(seen) // 2)
        assert [seen[rank, w] for w in range(len(seen) // 2)] == expected
