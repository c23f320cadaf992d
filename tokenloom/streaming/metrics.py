"""Run-log analytics on a stream of metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.runlog import WORST_LOSS, known_loss, thin_log


def live_best(metrics: DataFrame) -> DataFrame:
    """Best loss so far per run and the iteration that first reached it, in update mode, and
    ``is_saved``: whether that best was stored, which iteration 0 never is.

    Equal losses go to the earliest iteration, as a later one must be strictly better. Null and
    NaN losses, and losses that do not beat the opening mark, are never the best.
    """
    loss = known_loss(F.col("loss"))
    best = F.min(F.when(loss < WORST_LOSS, F.struct(loss.alias("loss"), "iter")))
    return metrics.groupBy("run").agg(best.alias("best"), F.count(F.lit(1)).alias("evals")).select(
        "run",
        F.col("best.loss").alias("loss"),
        F.col("best.iter").alias("iter"),
        "evals",
        F.coalesce(F.col("best.iter") > 0, F.lit(False)).alias("is_saved"),
    )


def live_log(metrics: DataFrame, interval: int) -> DataFrame:
    """The thinned log of the stream, in append mode."""
    return thin_log(metrics, interval)
