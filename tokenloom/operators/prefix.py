"""Running totals over many rows without an un-partitioned window.

Two levels: rows fall into ordered buckets, one small aggregate gives each bucket its offset, and
the row-level window runs inside a bucket only. Buckets are pure functions of row values, so a
retried task computes the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.functions.keys import key_bucket
from tokenloom.session import LOCAL_ROWS, broadcast_if_small, default_buckets, materialize

# Groups with more rows than this are cut into bins before they are windowed.
MAX_GROUP_ROWS = 4_000_000


def _exclusive(over: Sequence[str], order: str):
    return Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def hashed_prefix_sum(
    df: DataFrame,
    value: str,
    key: str,
    ties: Sequence[str],
    buckets: int | None = None,
    ordinal: str = "pos",
    before: str = "start",
    through: str = "end",
) -> DataFrame:
    """Row number (from 0) and running totals of ``value`` in the order of a hex ``key``.

    Hex keys from a digest are uniform, so equal key ranges hold equal shares of the rows
    whatever the sources look like. The bucket table has at most ``buckets`` rows.
    """
    buckets = buckets or default_buckets(df.sparkSession)
    placed = df.withColumn("_bucket", key_bucket(F.col(key), buckets))
    totals = placed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum")
    )
    earlier = _exclusive([], "_bucket")
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
    )
    order = Window.partitionBy("_bucket").orderBy(key, *ties)
    inclusive = order.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_ordinal", F.row_number().over(order)).withColumn(
        "_running", F.sum(value).over(inclusive)
    )
    joined = local.join(broadcast_if_small(offsets, buckets), "_bucket")
    return joined.select(
        *df.columns,
        (F.col("_rows_before") + F.col("_ordinal") - 1).alias(ordinal),
        (F.col("_sum_before") + F.col("_running") - F.col(value)).alias(before),
        (F.col("_sum_before") + F.col("_running")).alias(through),
    )


def order_bins(
    df: DataFrame,
    group: Sequence[str],
    axis: str,
    max_rows: int = MAX_GROUP_ROWS,
    bin_column: str = "_bin",
) -> tuple[DataFrame, int]:
    """Add ``bin_column``: null for ordinary groups, and for groups above ``max_rows`` the lower
    end of the row's range on the integer ``axis``, cut again until a range holds at most
    ``max_rows`` rows (or one axis value). Returns the frame and a bound on the number of
    oversized groups and ranges met (0 when no group is hot).

    The table of ranges to cut has at most rows / ``max_rows`` entries, so it is broadcast.
    """
    binned = df.withColumn(bin_column, F.lit(None).cast("long"))
    cuts = 0
    level = 0
    while True:
        crowded = (
            binned.groupBy(*group, bin_column)
            .agg(
                F.count(F.lit(1)).alias("_rows"),
                F.min(axis).alias("_low"),
                F.max(axis).alias("_high"),
            )
            .filter((F.col("_rows") > max_rows) & (F.col("_high") > F.col("_low")))
        )
        pieces = 4 * F.ceil(F.col("_rows") / F.lit(max_rows))
        width = F.ceil((F.col("_high") - F.col("_low") + 1) / pieces).cast("long")
        crowded = crowded.select(
            *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
            F.col(bin_column).alias("_at"),
            "_low",
            F.greatest(width, F.lit(1)).alias("_width"),
        )
        head = crowded.limit(LOCAL_ROWS + 1).toArrow()
        if head.num_rows <= LOCAL_ROWS:
            crowded = df.sparkSession.createDataFrame(head, crowded.schema)
        else:
            crowded = materialize(crowded, f"bins{level}")
        found = head.num_rows if head.num_rows <= LOCAL_ROWS else crowded.count()
        if found == 0:
            return binned, cuts
        cuts += found
        level += 1
        same = F.col(bin_column).eqNullSafe(F.col("_at"))
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        step = F.expr(f"(`{axis}` - _low) div _width")
        binned = binned.join(broadcast_if_small(crowded, found), same, "left").select(
            *df.columns,
            F.coalesce(F.col("_low") + step * F.col("_width"), F.col(bin_column)).alias(
                bin_column
            ),
        )


def grouped_running(
    df: DataFrame,
    group: Sequence[str],
    axis: str,
    order_by: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Per group and in ``order_by``, over the rows *before* each row: running sums (0 at the
    start), running minima (null at the start) and the previous row's value (null at the start).

    ``axis`` is an integer column that never decreases along ``order_by``. A group above
    ``max_rows`` is windowed bin by bin, with the bins' summaries carried across.
    """
    sums, mins, lags = sums or {}, mins or {}, lags or {}
    binned, cuts = order_bins(df, group, axis, max_rows)
    for name, value in {**sums, **mins, **lags}.items():
        binned = binned.withColumn(f"_v_{name}", value)
    order = Window.partitionBy(*group, "_bin").orderBy(*order_by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = binned
    for name in sums:
        out = out.withColumn(name, F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0)))
    for name in mins:
        out = out.withColumn(name, F.min(f"_v_{name}").over(before))
    for name in lags:
        out = out.withColumn(name, F.lag(f"_v_{name}").over(order))
    added = [*sums, *mins, *lags]
    if cuts == 0:
        return out.select(*df.columns, *added)

    out = out.withColumn("_first", F.row_number().over(order) == 1)
    last = F.struct(*order_by)
    summary = binned.filter(F.col("_bin").isNotNull()).groupBy(*group, "_bin")
    summary = summary.agg(
        *[F.sum(f"_v_{n}").alias(n) for n in sums],
        *[F.min(f"_v_{n}").alias(n) for n in mins],
        *[F.max_by(f"_v_{n}", last).alias(n) for n in lags],
        F.count(F.lit(1)).alias("_rows"),
    )
    earlier = _exclusive(group, "_bin")
    previous = Window.partitionBy(*group).orderBy("_bin")
    carried = summary.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_bin").alias("_b"),
        *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.min(n).over(earlier).alias(f"_c_{n}") for n in mins],
        *[F.lag(n).over(previous).alias(f"_c_{n}") for n in lags],
    )
    carried = materialize(carried, "carried")
    same = F.col("_bin") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = out.join(broadcast_if_small(carried, carried.count()), same, "left")
    total = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    total |= {n: F.least(F.col(n), F.col(f"_c_{n}")) for n in mins}
    total |= {
        n: F.when(F.col("_first"), F.col(f"_c_{n}")).otherwise(F.col(n)) for n in lags
    }
    return joined.select(*df.columns, *[total[n].alias(n) for n in added])
