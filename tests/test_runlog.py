import math

import pytest
from pyspark.sql import functions as F

from tokenloom.operators.runlog import (
    best_so_far,
    eval_mean,
    iter_time,
    latest_artifact,
    learning_rate,
    retention,
    thin_log,
    topk_draw,
)


def test_eval_mean_weighs_ranks_equally(spark):
    rows = [("r", 0, "val", 0, 1.0), ("r", 0, "val", 0, 3.0), ("r", 0, "val", 1, 6.0)]
    df = spark.createDataFrame(rows, "run string, step long, split string, rank int, loss double")
    row = eval_mean(df).first()
    assert (row["loss"], row["ranks"]) == (4.0, 2)


@pytest.mark.parametrize("max_rows", [100, 2])
def test_best_is_strict_and_iteration_zero_is_not_saved(spark, max_rows):
    losses = [3.0, 3.0, 2.0, 2.0, 2.5, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(losses)],
                               "run string, iter long, loss double")
    rows = best_so_far(df, max_rows).orderBy("iter").collect()
    assert [r["best_before"] for r in rows] == [1e9, 3.0, 3.0, 2.0, 2.0, 2.0]
    assert [r["is_best"] for r in rows] == [True, False, True, False, False, True]
    assert [r["is_saved"] for r in rows] == [False, False, True, False, False, True]


def test_a_loss_above_the_opening_mark_is_never_best(spark):
    df = spark.createDataFrame([("a", 1, 2e9), ("a", 2, 5.0)], "run string, iter long, loss double")
    rows = best_so_far(df).orderBy("iter").collect()
    assert [r["is_best"] for r in rows] == [False, True]
    assert rows[1]["best_before"] == 1e9


@pytest.mark.parametrize("max_rows", [100, 1])
def test_iteration_time(spark, max_rows):
    df = spark.createDataFrame([("a", 0, 10), ("a", 1, 13), ("a", 5, 20), ("b", 0, 1)],
                               "run string, iter long, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    rows = {(r["run"], r["iter"]): r["elapsed_us"] for r in iter_time(df, max_rows).collect()}
    assert rows == {("a", 0): None, ("a", 1): 3_000_000, ("a", 5): 7_000_000, ("b", 0): None}


def test_thinning(spark):
    df = spark.range(25).withColumnRenamed("id", "iter")
    assert [r[0] for r in thin_log(df, 10).collect()] == [0, 10, 20]


def test_latest_artifact(spark):
    listing = {
        "numbered": ["ckpt_00000010.pt", "ckpt_00000002.pt", "ckpt_00000099.pt.tmp", "best.pt"],
        "plain": ["best.pt", "ckpt.pt"],
        "best": ["best.pt"],
        "none": ["ckpt_x.pt.tmp", "notes.txt"],
        "wide": ["ckpt_9.pt", "ckpt_10.pt", "my_ckpt_77.pt"],
    }
    rows = [(run, f"out/{run}/{name}") for run, names in listing.items() for name in names]
    df = spark.createDataFrame(rows, "run string, path string")
    got = {r["run"]: (r["path"], r["step"]) for r in latest_artifact(df).collect()}
    assert got == {
        "numbered": ("out/numbered/ckpt_00000010.pt", 10),
        "plain": ("out/plain/ckpt.pt", None),
        "best": ("out/best/best.pt", None),
        "none": (None, None),
        "wide": ("out/wide/ckpt_10.pt", 10),
    }


def test_retention(spark):
    rows = [("a", "p0", 0, 0.5), ("a", "p1", 1, 0.9), ("a", "p2", 2, 0.7),
            ("b", "q1", 1, 0.4), ("b", "q2", 2, 0.4), ("b", "q3", 3, 0.6)]
    df = spark.createDataFrame(rows, "run string, path string, step long, loss double")
    got = {r["path"]: (r["is_latest"], r["is_best"], r["keep"]) for r in retention(df).collect()}
    assert got["p0"] == (False, False, False)
    assert got["p2"] == (True, False, True)
    assert got["q1"] == (False, True, True)
    assert got["q2"] == (False, False, False)
    assert got["q3"] == (True, False, True)


def test_schedule(spark):
    peak, floor, warm, end = 6e-4, 6e-5, 5, 40
    rows = spark.range(50).select("id", learning_rate(F.col("id"), peak, floor, warm, end).alias("lr"))
    for r in rows.collect():
        i = r["id"]
        if i < warm:
            expected = peak * (i + 1) / (warm + 1)
        elif i > end:
            expected = floor
        else:
            expected = floor + 0.5 * (1 + math.cos(math.pi * (i - warm) / (end - warm))) * (peak - floor)
        assert r["lr"] == pytest.approx(expected, rel=1e-12)
    with pytest.raises(ValueError):
        learning_rate(F.col("id"), peak, floor, 10, 5)


def test_topk_keeps_ties_and_follows_the_masses(spark):
    scores = [("a", i, s) for i, s in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])]
    df = spark.createDataFrame(scores, "k string, item long, score double")
    mass = [math.exp((s - 5.0) / 2.0) for s in (5.0, 4.0, 4.0, 4.0)]
    through = [sum(mass[: i + 1]) / sum(mass) for i in range(4)]
    for u in (0.0, 0.3, 0.5, 0.7, 0.9, 0.999999):
        rows = topk_draw(df, "k", "item", 2, 2.0, F.lit(u)).collect()
        assert len(rows) == 1 and rows[0]["candidates"] == 4
        expected = next(i for i, t in enumerate(through) if t > u)
        assert rows[0]["item"] == expected
        assert rows[0]["probability"] == pytest.approx(mass[expected] / sum(mass))
    plan = topk_draw(df, "k", "item", 2, 2.0, F.lit(0.5))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
