"""Position to interval lookup as an equi-join on cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import broadcast_if_small


def interval_lookup(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    low: str,
    high: str,
    width: int,
    rows: int,
    keep: Sequence[str],
) -> DataFrame:
    """Join each row of ``points`` with the interval that holds it (``low <= point < high``).

    Both sides are cut into cells of ``width``, which turns the range condition into a hash join:
    a point meets only the few intervals of its cell, never the whole table. ``rows`` is the
    number of intervals, known to the caller; the interval side is broadcast below the limit and
    shuffled by cell above it. With disjoint intervals and ``width`` near their mean length, the
    cells hold about two entries per interval in total.
    """
    width = max(1, int(width))
    cells = intervals.filter(F.col(high) > F.col(low)).select(
        F.explode(F.expr(f"sequence(`{low}` div {width}, (`{high}` - 1) div {width})")).alias(
            "_cell"
        ),
        F.col(low).alias("_low"),
        F.col(high).alias("_high"),
        *keep,
    )
    placed = points.withColumn("_cell", F.expr(f"`{point}` div {width}"))
    joined = placed.join(broadcast_if_small(cells, 3 * rows), "_cell").filter(
        (F.col(point) >= F.col("_low")) & (F.col(point) < F.col("_high"))
    )
    return joined.drop("_cell", "_low", "_high")
