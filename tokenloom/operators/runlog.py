"""Run-log analytics over metric and artifact tables of many runs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from tokenloom.operators.prefix import MAX_GROUP_ROWS, grouped_running

# The best loss before any was seen, and the artifact names.
WORST_LOSS = 1e9
STEP_NAME = r"(?:^|/)ckpt_(\d+)\.pt$"
ANY_STEP_NAME = r"(?:^|/)ckpt_[^/]*\.pt$"
LEGACY_NAMES = ("ckpt.pt", "best.pt")


def known_loss(loss: Column) -> Column:
    """The loss where there is one: a null or NaN loss is no loss."""
    return F.when(~F.isnan(loss), loss)


def eval_mean(
    losses: DataFrame, by: Sequence[str] = ("run", "step", "split"), rank: str = "rank"
) -> DataFrame:
    """Mean over ranks of each rank's mean loss; a rank counts once however many rows it has."""
    per_rank = losses.groupBy(*by, rank).agg(F.avg("loss").alias("rank_loss"))
    return per_rank.groupBy(*by).agg(
        F.avg("rank_loss").alias("loss"), F.count(F.lit(1)).alias("ranks")
    )


def iter_time(log: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add ``elapsed_us`` since the run's previous iteration (null at its first)."""
    now = F.unix_micros("ts")
    timed = grouped_running(
        log, ["run"], "iter", ["iter"], lags={"_previous": now}, max_rows=max_rows
    )
    return timed.withColumn("elapsed_us", now - F.col("_previous")).drop("_previous")


def thin_log(log: DataFrame, interval: int) -> DataFrame:
    """Iterations that are multiples of ``interval``."""
    return log.filter(F.col("iter") % interval == 0)


def best_so_far(evals: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add ``best_before``, ``is_best`` (strictly below it) and ``is_saved`` (not at iteration 0).

    A null or NaN loss is never the best and changes no mark.
    """
    loss = known_loss(F.col("loss"))
    tracked = grouped_running(evals, ["run"], "iter", ["iter"], mins={"_min": loss}, max_rows=max_rows)
    before = F.least(F.coalesce(F.col("_min"), F.lit(WORST_LOSS)), F.lit(WORST_LOSS))
    return (
        tracked.withColumn("best_before", before)
        .withColumn("is_best", F.coalesce(loss < F.col("best_before"), F.lit(False)))
        .withColumn("is_saved", F.col("is_best") & (F.col("iter") > 0))
        .drop("_min")
    )


def artifact_step(path: Column) -> Column:
    """Step of a numbered artifact; null for temporary and other names, and for a number that is
    none of 64 bits.
    """
    digits = F.regexp_extract(path, STEP_NAME, 1)
    return F.when(digits != "", digits.try_cast("long"))


def latest_artifact(listing: DataFrame) -> DataFrame:
    """Per run, the artifact to resume from: the highest step, else any other ``ckpt_`` name (of
    several the last in text order), else the legacy names in order.

    Runs that have none of these are listed with a null path.
    """
    base = F.element_at(F.split("path", "/"), -1)
    step = artifact_step(F.col("path"))
    found = listing.groupBy("run").agg(
        F.max(step).alias("step"),
        F.max(F.when(step.isNotNull(), F.struct(step.alias("s"), F.col("path").alias("p")))).alias(
            "_numbered"
        ),
        F.max(F.when(F.col("path").rlike(ANY_STEP_NAME), F.col("path"))).alias("_unnumbered"),
        *[F.max(F.when(base == n, F.col("path"))).alias(f"_legacy{i}")
          for i, n in enumerate(LEGACY_NAMES)],
    )
    legacy = [F.col(f"_legacy{i}") for i in range(len(LEGACY_NAMES))]
    path = F.coalesce(F.col("_numbered.p"), F.col("_unnumbered"), *legacy)
    return found.select("run", path.alias("path"), "step")


def retention(listing: DataFrame) -> DataFrame:
    """Add ``is_latest``, ``is_best`` and ``keep`` to ``(run, path, step, loss)``; deletes nothing.

    The best is the lowest loss of the run, and of equal losses the earliest step, since a later
    one must be strictly better; step 0 sets the mark to beat but is never kept for it. A null or
    NaN loss is never the best. Two values per run are found by aggregates with map-side combine
    and joined back by a plain join, which AQE splits for a very long run.
    """
    loss = known_loss(F.col("loss"))
    best = F.min(F.when(loss.isNotNull(), F.struct(loss.alias("loss"), "step")))
    marks = listing.groupBy("run").agg(F.max("step").alias("_latest"), best.alias("_best"))
    is_best = (F.col("step") == F.col("_best.step")) & (F.col("step") > 0)
    is_best = F.coalesce(is_best, F.lit(False))
    return (
        listing.join(marks, "run")
        .select(
            *listing.columns,
            F.coalesce(F.col("step") == F.col("_latest"), F.lit(False)).alias("is_latest"),
            is_best.alias("is_best"),
        )
        .withColumn("keep", F.col("is_latest") | F.col("is_best"))
    )


def learning_rate(
    step: Column, peak: float, floor: float, warmup: int, decay_end: int
) -> Column:
    """Linear warm-up to ``peak``, cosine decay to ``floor`` at ``decay_end``, then ``floor``."""
    if decay_end < warmup:
        raise ValueError("the decay must not end before the warm-up")
    rising = F.lit(peak) * (step + 1) / F.lit(warmup + 1)
    done = (step - warmup) / F.lit(max(decay_end - warmup, 1))
    falling = F.lit(floor) + F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * done)) * F.lit(
        peak - floor
    )
    return F.when(step < warmup, rising).when(step > decay_end, F.lit(floor)).otherwise(falling)


def topk_draw(
    scores: DataFrame,
    key: str,
    item: str,
    k: int,
    temperature: float,
    uniform: Column,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """One weighted draw per key among its ``k`` best scores, ties with the k-th kept.

    ``scores`` is ``(key, item, score)``; ``uniform`` in ``[0, 1)`` may depend on the key only.
    Gives ``key, item, probability, candidates``.

    The draw is made in two steps. Candidates of one score are a class, counted with map-side
    combine: at most ``k`` classes of a key are windowed, however many rows tie. The uniform's place
    in the classes' masses gives the class and a place in it, in the order of items; only the
    drawn class is looked at again, and one of more than ``max_rows`` rows bin by bin where items
    are whole numbers.
    """
    if k < 1 or temperature <= 0:
        raise ValueError("k and temperature must be positive")
    scaled = scores.select(key, item, (F.col("score") / F.lit(temperature)).alias("_scaled"))
    classes = scaled.groupBy(key, "_scaled").agg(F.count(F.lit(1)).alias("_rows"))
    best = Window.partitionBy(key).orderBy(F.col("_scaled").desc())
    earlier = best.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    # Every class has a row, so the first k classes hold the k best scores.
    first = classes.withColumn("_class", F.row_number().over(best)).filter(F.col("_class") <= k)
    ahead = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    kept = first.withColumn("_ahead", ahead).filter(F.col("_ahead") < k)
    weighed = (
        kept.withColumn("_mass", F.exp(F.col("_scaled") - F.max("_scaled").over(whole)))
        .withColumn("_before", F.coalesce(F.sum(F.col("_mass") * F.col("_rows")).over(earlier), F.lit(0.0)))
        .withColumn("_through", F.col("_before") + F.col("_mass") * F.col("_rows"))
        .withColumn("_total", F.max("_through").over(whole))
        .withColumn("candidates", F.sum("_rows").over(whole))
    )
    # The first class whose running mass passes the goal, and the place inside it.
    goal = uniform * F.col("_total")
    place = F.floor((goal - F.col("_before")) / F.col("_mass")).cast("long")
    drawn = weighed.filter((F.col("_through") > goal) & (F.col("_before") <= goal)).select(
        key,
        "_scaled",
        F.least(place, F.col("_rows") - 1).alias("_place"),
        (F.col("_mass") / F.col("_total")).alias("probability"),
        "candidates",
    )
    members = scaled.join(drawn, [key, "_scaled"])
    if isinstance(scores.schema[item].dataType, (ByteType, ShortType, IntegerType, LongType)):
        one = {"_nth": F.lit(1).cast("long")}
        ranked = grouped_running(members, [key], item, [item], sums=one, max_rows=max_rows)
    else:
        nth = F.row_number().over(Window.partitionBy(key).orderBy(item)) - 1
        ranked = members.withColumn("_nth", nth)
    return ranked.filter(F.col("_nth") == F.col("_place")).select(
        key, item, "probability", "candidates"
    )
