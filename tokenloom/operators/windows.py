"""Training windows over a positioned token stream, and the schedules that read them.

Stream rows are ``(start, end, tokens)``: documents, fragments or file chunks. A window is always
addressed by its global start, so it may span any number of them. Rows are cut into window pieces
inside the row; a piece is shuffled once, to its window, and no group is larger than one window
(or one batch).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.keys import keyed_draw
from tokenloom.operators.lookup import interval_lookup
from tokenloom.operators.shards import slice_ids
from tokenloom.session import BROADCAST_ROWS, broadcast_if_small


@dataclass(frozen=True)
class RankPlan:
    """Equal contiguous ranges of a stream for ``world`` readers of windows of ``block`` tokens."""

    total: int
    world: int
    block: int

    def __post_init__(self) -> None:
        if self.world <= 0 or self.block <= 0:
            raise ValueError("world and block must be positive")
        if self.tokens_per_rank < self.block + 1:
            raise ValueError(
                f"a rank's {self.tokens_per_rank} tokens do not hold one window of {self.block + 1}"
            )

    @property
    def tokens_per_rank(self) -> int:
        return self.total // self.world

    @property
    def windows_per_rank(self) -> int:
        """Windows read before the pointer returns to the start of the range."""
        return (self.tokens_per_rank - 1) // self.block


def rank_ranges(spark: SparkSession, plan: RankPlan) -> DataFrame:
    """``(rank, low, high, windows)``; the remainder of the stream belongs to no rank."""
    per = plan.tokens_per_rank
    return spark.range(plan.world).select(
        F.col("id").alias("rank"),
        (F.col("id") * per).alias("low"),
        ((F.col("id") + 1) * per).alias("high"),
        F.lit(plan.windows_per_rank).cast("long").alias("windows"),
    )


def _window_pieces(stream: DataFrame, plan: RankPlan, only: str = "_hi > lo") -> DataFrame:
    """``(rank, window, lo, piece)``: the part of each window that each stream row holds."""
    per, block, last = plan.tokens_per_rank, plan.block, plan.windows_per_rank - 1
    used = per * plan.world
    ranks = f"sequence(start div {per}, least((end - 1) div {per}, {plan.world - 1}L))"
    first_window = f"(greatest(start - r * {per}, 1L) - 1) div {block}"
    last_window = f"least((end - r * {per} - 1) div {block}, {last}L)"
    ranges = F.expr(f"""
        flatten(transform({ranks}, r ->
          if({first_window} <= {last_window},
             transform(sequence({first_window}, {last_window}), w ->
               named_struct('rank', r, 'window', w,
                            'lo', greatest(start, r * {per} + w * {block}),
                            '_hi', least(end, r * {per} + w * {block} + {block + 1}))),
             array())))
    """)
    inside = stream.filter(f"end > start and start < {used}").select("start", "end", "tokens")
    # Ranges are exploded and ids sliced above them in the same generated code: see
    # ``split_fragments``.
    return inside.select("start", "tokens", F.inline_outer(ranges)).filter(only).select(
        "rank", "window", "lo", slice_ids("tokens", "lo", "_hi").alias("piece")
    )


def _joined() -> Column:
    """Ids of the grouped pieces, in stream order."""
    parts = F.sort_array(F.collect_list(F.struct("lo", "piece")))
    return F.flatten(F.transform(parts, lambda part: part["piece"]))


def sequential_windows(stream: DataFrame, plan: RankPlan) -> DataFrame:
    """``(rank, window, tokens)``: ``block + 1`` ids every ``block`` tokens of each rank's range.

    Neighbouring windows share one token. No window leaves its rank's range.
    """
    return _window_pieces(stream, plan).groupBy("rank", "window").agg(_joined().alias("tokens"))


def edge_pieces(stream: DataFrame, plan: RankPlan) -> DataFrame:
    """``(rank, window, lo, piece)`` of the windows that no stream row holds whole: at most
    ``block`` ids at either end of a row.
    """
    return _window_pieces(stream, plan, f"_hi > lo and _hi - lo <= {plan.block}")


def stored_windows(stream: DataFrame, plan: RankPlan) -> DataFrame:
    """``sequential_windows`` of a stored stream of long rows (token files, shards).

    A window inside one row is cut where the row is read; only the edge pieces are shuffled. The
    rows are read twice, so the stream should be stored, not computed.
    """
    whole = _window_pieces(stream, plan, f"_hi - lo = {plan.block + 1}")
    edges = edge_pieces(stream, plan).groupBy("rank", "window").agg(_joined().alias("tokens"))
    return whole.select("rank", "window", F.col("piece").alias("tokens")).unionByName(edges)


def next_token_pairs(windows: DataFrame, block: int, tokens: str = "tokens") -> DataFrame:
    """Replace the ids by ``x`` and ``y``, where ``y`` is ``x`` one token later."""
    rest = [c for c in windows.columns if c != tokens]
    return windows.select(
        *rest,
        F.slice(tokens, 1, block).alias("x"),
        F.slice(tokens, 2, block).alias("y"),
    )


def epoch_schedule(spark: SparkSession, plan: RankPlan, draws: int) -> DataFrame:
    """``(rank, draw, epoch, window)`` for the first ``draws`` windows each rank reads."""
    per = plan.windows_per_rank
    return spark.range(draws * plan.world).select(
        F.expr(f"id div {draws}").alias("rank"),
        F.expr(f"id % {draws}").alias("draw"),
        F.expr(f"(id % {draws}) div {per}").alias("epoch"),
        F.expr(f"(id % {draws}) % {per}").alias("window"),
    )


def batch_columns(draw: Column, accum: int, batch: int) -> list[Column]:
    """``step, micro, slot`` of a rank's draw number."""
    number = draw.cast("long")
    return [
        F.floor(number / F.lit(accum * batch)).cast("long").alias("step"),
        F.floor((number % F.lit(accum * batch)) / F.lit(batch)).cast("long").alias("micro"),
        (number % F.lit(batch)).alias("slot"),
    ]


def batch_schedule(
    spark: SparkSession, plan: RankPlan, steps: int, accum: int, batch: int
) -> DataFrame:
    """``(step, micro, slot, rank, draw, window)``: which window fills each slot.

    ``accum`` is the number of micro-steps per rank and step.
    """
    schedule = epoch_schedule(spark, plan, steps * accum * batch)
    return schedule.select(*batch_columns(F.col("draw"), accum, batch), "rank", "draw", "window")


def assemble_batches(
    stream: DataFrame, plan: RankPlan, steps: int, accum: int, batch: int
) -> DataFrame:
    """``(step, micro, rank, x, y)``: the sequential schedule's batches, slots in order, ids wide.

    A window's draw numbers follow from its index (one per epoch), so the schedule is computed,
    not joined, and every piece goes straight to its batch: windows and batches are both built
    behind one shuffle.
    """
    draws = steps * accum * batch
    per = plan.windows_per_rank
    epochs = F.expr(f"sequence(0L, ({draws - 1}L - window) div {per})")
    read = (
        _window_pieces(stream, plan)
        .filter(f"window < {draws}")
        .withColumn("epoch", F.explode(epochs))
    )
    placed = read.select(
        *batch_columns(F.col("epoch") * per + F.col("window"), accum, batch), "rank", "lo", "piece"
    ).repartition("step", "micro", "rank")
    windows = placed.groupBy("step", "micro", "rank", "slot").agg(_joined().alias("tokens"))
    return _stack(windows, ["step", "micro", "rank"], plan.block)


def _stack(windows: DataFrame, batch_key: list[str], block: int) -> DataFrame:
    """Windows of a batch side by side, in slot order, ids widened to 64 bits.

    Ids are cut and widened before they are gathered: inside a function over the gathered slots
    every id would become an object. ``windows`` should be partitioned by the batch already, so that
    wide ids are not shuffled.
    """
    x, y = F.slice("tokens", 1, block), F.slice("tokens", 2, block)
    wide = windows.select(
        *batch_key, "slot", x.cast("array<bigint>").alias("x"), y.cast("array<bigint>").alias("y")
    )
    slots = F.sort_array(F.collect_list(F.struct("slot", "x", "y")))
    stacked = wide.groupBy(*batch_key).agg(slots.alias("_slots"))
    return stacked.select(
        *batch_key, F.col("_slots")["x"].alias("x"), F.col("_slots")["y"].alias("y")
    )


def random_draws(
    spark: SparkSession, seed: int, split: str, steps: int, batch: int, bound: int
) -> DataFrame:
    """``(step, slot, start)`` with repeatable starts in ``[0, bound)``."""
    if bound <= 0:
        raise ValueError(f"the {split} stream is too short for one window")
    step, slot = F.expr(f"id div {batch}"), F.expr(f"id % {batch}")
    return spark.range(steps * batch).select(
        step.alias("step"),
        slot.alias("slot"),
        keyed_draw(bound, F.lit(str(seed)), F.lit(split), step, slot).alias("start"),
    )


def val_draws(
    spark: SparkSession, seed: int, steps: int, batch: int, val_tokens: int, block: int
) -> DataFrame:
    """Window starts over the validation split."""
    return random_draws(spark, seed, "val", steps, batch, val_tokens - block)


def train_draws(
    spark: SparkSession,
    seed: int,
    steps: int,
    batch: int,
    shards: DataFrame,
    shard_tokens: int,
    block: int,
) -> DataFrame:
    """Window starts over the training shards, ``(step, slot, drawn, shard_id, start, clamped)``.

    A draw within the last ``block + 1`` tokens of its shard moves back to the last full window,
    so no window crosses a shard. ``shards`` is ``(shard_id, low, high)``.
    """
    facts = shards.agg(
        F.max("high").alias("total"),
        F.min(F.col("high") - F.col("low")).alias("shortest"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    if facts["rows"] == 0 or facts["shortest"] < block + 1:
        raise ValueError(f"every shard must hold one window of {block + 1} tokens")
    draws = random_draws(spark, seed, "train", steps, batch, facts["total"] - block - 1)
    bounds = shards.select("shard_id", "low", "high", F.col("high").alias("stop"))
    bounds = bounds.withColumn("base", F.col("low"))
    placed = interval_lookup(
        draws.withColumnRenamed("start", "drawn"),
        bounds,
        "drawn",
        "low",
        "high",
        shard_tokens,
        facts["rows"],
        ["shard_id", "base", "stop"],
    )
    last = F.col("stop") - (block + 1)
    return placed.select(
        "step",
        "slot",
        "drawn",
        "shard_id",
        F.least("drawn", last).alias("start"),
        (F.col("drawn") > last).alias("clamped"),
    )


def windows_at(stream: DataFrame, draws: DataFrame, block: int, rows: int) -> DataFrame:
    """Add to each draw its ``block + 1`` ids, ``tokens``, from ``start`` on.

    Draws and stream rows meet in cells of ``block`` tokens, two (at most three) per draw, by hash
    join. ``rows`` is the number of draws: up to the broadcast limit only the cells that some draw
    reads are cut out and leave their task, and beyond it both sides shuffle by cell.
    """
    width = block + 1
    named = draws.withColumn("_draw", F.struct(*draws.columns))
    wanted = named.select(
        "_draw",
        F.col("start").alias("_from"),
        F.explode(F.expr(f"sequence(start div {width}, (start + {block}) div {width})")).alias(
            "_cell"
        ),
    )
    cells = F.expr(f"""
        transform(sequence(start div {width}, (end - 1) div {width}), c ->
          named_struct('_cell', c, 'lo', greatest(start, c * {width}),
                       '_hi', least(end, (c + 1) * {width})))
    """)
    pieces = stream.filter("end > start").select("start", "tokens", F.inline_outer(cells))
    part = slice_ids("tokens", "lo", "_hi").alias("part")
    if 2 * rows <= BROADCAST_ROWS:
        # Cells meet the draws inside the generated code of the scan; only those hit are sliced.
        met = pieces.join(F.broadcast(wanted), "_cell").select("_draw", "_from", "lo", "_hi", part)
    else:
        met = pieces.select("_cell", "lo", "_hi", part).join(wanted, "_cell")
    low = F.greatest("lo", "_from")
    high = F.least(F.col("_hi"), F.col("_from") + width)
    cut = met.filter(high > low).select(
        "_draw",
        low.alias("lo"),
        F.slice("part", (low - F.col("lo") + 1).cast("int"), (high - low).cast("int")).alias(
            "piece"
        ),
    )
    return (
        cut.groupBy("_draw").agg(_joined().alias("tokens")).select("_draw.*", "tokens")
    )


def stack_random_batches(windows: DataFrame, block: int) -> DataFrame:
    """``(step, x, y)`` of randomly drawn windows, slots in order whatever order they were read."""
    placed = windows.select("step", "slot", "tokens").repartition("step")
    return _stack(placed, ["step"], block)
