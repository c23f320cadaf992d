import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from models import pack
from tokenloom.operators.nextfit import assign_shards, next_fit_cuts, shards_by_quotient
from tokenloom.operators.shards import (
    holdout_size,
    shard_stats,
    shard_table,
    split_fragments,
    split_stats,
)


def positioned(spark, sizes):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((i, at, at + n, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "pos long, start long, end long, tokens array<int>"), at


def packed(spark, sizes, limit, span=None, **bound):
    docs, total = positioned(spark, sizes)
    cuts = next_fit_cuts(docs.repartition(4), limit, total, len(sizes), span, **bound)
    placed = assign_shards(docs.drop("tokens"), cuts, limit, cuts.count())
    return [r["shard_id"] for r in placed.orderBy("pos").collect()]


CASES = [
    ([5], None),
    ([30], None),
    ([11, 3, 3], 10),
    ([3, 11, 3, 25, 1, 1], 13),
    ([40, 40, 1, 9, 1, 10, 10], 10),
    ([1] * 35, None),
]


@pytest.mark.parametrize("sizes,span", CASES)
def test_packing_equals_the_greedy_loop(spark, sizes, span):
    assert packed(spark, sizes, 10, span) == pack(sizes, 10)


def test_packing_over_many_segments(spark):
    """Random sizes, some far over the limit, over dozens of segments."""
    rng = random.Random(11)
    sizes = [rng.choice([1, 2, 5, 17, 40, rng.randrange(1, 300)]) for _ in range(3000)]
    assert packed(spark, sizes, 100, span=1_500) == pack(sizes, 100)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 25), st.integers(0, 3))
def test_packing_properties(spark, sizes, limit, widen):
    found = packed(spark, sizes, limit, span=limit * (1 + widen))
    assert found == pack(sizes, limit)
    for shard in set(found):
        held = [n for n, s in zip(sizes, found) if s == shard]
        assert sum(held) <= limit or len(held) == 1
    for i in range(1, len(sizes)):
        if found[i] != found[i - 1]:
            before = [n for n, s in zip(sizes, found) if s == found[i - 1]]
            assert sum(before) + sizes[i] > limit


def test_segments_stay_small_where_short_documents_stand_together(spark):
    from tokenloom.operators import nextfit

    sizes = [50] * 40 + [1] * 400 + [50] * 40
    docs, total = positioned(spark, sizes)
    span = nextfit._segment_span(docs, 20, total, len(sizes), 60)
    assert 20 <= span <= 60
    assert packed(spark, sizes, 20, segment_docs=60) == pack(sizes, 20)


@pytest.mark.parametrize("limit", [40, 2_300, 100_000])
def test_no_group_grows_with_the_limit(spark, monkeypatch, limit):
    """Shards of more documents than a task may hold; some documents far over limit and cell."""
    from tokenloom.operators import nextfit

    monkeypatch.setattr(nextfit, "CELL_TOKENS", 16)
    rng = random.Random(limit)
    sizes = [rng.choice([1, 1, 2, 3, rng.randrange(1, 90)]) for _ in range(900)]
    sizes[300:300] = [3_000, 1, 2_301]
    docs, total = positioned(spark, sizes)
    assert nextfit._segment_span(docs, limit, total, len(sizes), 5) is None
    assert packed(spark, sizes, limit, segment_docs=5) == pack(sizes, limit)


def test_shard_ends_of_all_documents(spark, monkeypatch):
    from tokenloom.operators import nextfit

    monkeypatch.setattr(nextfit, "CELL_TOKENS", 7)
    sizes = [5, 1, 1, 30, 2, 9, 10, 1, 1, 1, 4, 25]
    docs, total = positioned(spark, sizes)
    spans = [(r["start"], r["end"]) for r in docs.orderBy("start").collect()]
    expected = []
    for low, end in spans:
        goal = low + 10
        inside = [s for s, _ in spans if s <= goal]
        expected.append((low, end if end > goal else total if goal >= total else max(inside)))
    found = nextfit.shard_ends(docs.repartition(3), 10, total)
    assert sorted(map(tuple, found.collect())) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_empty_stream_has_no_shards(spark):
    docs, total = positioned(spark, [])
    assert next_fit_cuts(docs, 10, total, 0).count() == 0


def test_quotient_packing(spark):
    docs, _ = positioned(spark, [6, 6, 6])
    assert [r["shard_id"] for r in shards_by_quotient(docs, 10).orderBy("pos").collect()] == [0, 0, 1]


@pytest.mark.parametrize("total,cap,expected", [(100, 50, 10), (1000, 50, 50), (5, 50, 0), (100, 0, 0)])
def test_holdout_size(total, cap, expected):
    assert holdout_size(total, cap) == expected


@pytest.mark.parametrize("val", [0, 1, 10, 23, 60])
@pytest.mark.parametrize("limit", [5, 1000])
def test_fragments_reproduce_the_stream(spark, val, limit):
    sizes = [7, 3, 1, 24, 2, 5, 18]
    docs, total = positioned(spark, sizes)
    rows = split_fragments(docs.repartition(3), val, limit).collect()
    by_split = {"val": {}, "train": {}}
    for r in rows:
        assert len(r["tokens"]) == r["end"] - r["start"] > 0
        assert r["start"] // limit == (r["end"] - 1) // limit == r["shard_id"] or r["split"] == "val"
        for i, t in enumerate(r["tokens"]):
            by_split[r["split"]][r["start"] + i] = t
    assert by_split["val"] == {i: i for i in range(min(val, total))}
    assert by_split["train"] == {i: i + val for i in range(total - val)}
    full = {r["shard_id"]: 0 for r in rows if r["split"] == "train"}
    for r in rows:
        if r["split"] == "train":
            full[r["shard_id"]] += len(r["tokens"])
    last = max(full, default=0)
    assert all(n == limit for s, n in full.items() if s != last)
    slim = split_fragments(docs.drop("tokens"), val, limit, None)
    assert slim.count() == len(rows)
    stats = {r["split"]: (r["tokens"], r["shards"]) for r in split_stats(slim).collect()}
    assert stats.get("train", (0, 0)) == (total - val, len(full))


def test_shard_table_and_stats(spark):
    table = [tuple(r) for r in shard_table(spark, 25, 10).orderBy("shard_id").collect()]
    assert table == [(0, 0, 10), (1, 10, 20), (2, 20, 25)]
    docs = spark.createDataFrame([(0, 5), (0, 6), (1, 7)], "shard_id long, n_tokens long")
    assert {tuple(r) for r in shard_stats(docs).collect()} == {(0, 2, 11), (1, 1, 7)}
