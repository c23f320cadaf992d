"""Exact next-fit packing of a document stream into shards, in a fixed number of jobs.

A shard that opens at position ``c`` closes before the first document that would take it over the
limit, so the next shard opens at a document that depends on ``c`` alone: the document that holds
position ``c + limit``, or, when the document at ``c`` is itself larger than the limit, the one
after it. Packing follows these jumps from position 0.

The stream is cut into segments many shards long. One task per segment works out, for every
document at which an earlier shard might end inside it, where the jumps leave the segment. Those
entry-to-exit rows are then doubled (2, 4, 8, ... segments at a time) until the entries that the
real chain visits are known, and a last pass per segment lists the cuts. The number of jobs grows
with the logarithm of the number of segments, not with the number of shards.

Where a single shard may hold more documents than one task should, no segment is made. The jump of
every document is then found by a window over short cells of the stream, and the jumps themselves
are doubled until the chain from position 0 is known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.operators.lookup import interval_lookup
from tokenloom.session import broadcast_if_small, local_table, materialize, settle

# Shards per segment, and the documents that may start in a segment (a task also sees those of one
# limit beyond it, so at most about twice as many).
SEGMENT_SHARDS = 64
SEGMENT_DOCS = 8_000_000
# Positions per cell in which shard ends are looked up, where no segment is short enough; a cell
# holds at most one document start and one shard end per position.
CELL_TOKENS = 65_536


def _jumps(docs: pd.DataFrame, limit: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted document starts and, for each, the start of the next shard."""
    docs = docs.sort_values("start")
    start = docs["start"].to_numpy(np.int64)
    end = docs["end"].to_numpy(np.int64)
    goal = start + limit
    holder = start[np.searchsorted(start, goal, side="right") - 1]
    jump = np.where(end > goal, end, np.where(goal >= total, total, holder))
    return start, jump


def _exits(start: np.ndarray, jump: np.ndarray, stop: int) -> np.ndarray:
    """Where the jumps from each start first reach ``stop`` or beyond."""
    where = jump
    while True:
        inside = np.flatnonzero(where < stop)
        if not len(inside):
            return where
        where = where.copy()
        where[inside] = where[np.searchsorted(start, where[inside])]


def _segments(docs: DataFrame, limit: int, span: int) -> DataFrame:
    """Documents by segment, each also sent to the segments whose jumps may land on it."""
    first = F.greatest(F.expr(f"(start - {limit}) div {span}"), F.lit(0).cast("long"))
    return docs.select(
        F.explode(F.sequence(first, F.expr(f"start div {span}"))).alias("segment"), "start", "end"
    )


def _segment_span(
    docs: DataFrame, limit: int, total: int, rows: int, most_docs: int
) -> int | None:
    """Tokens per segment: many shards, but no more than ``most_docs`` documents in any, also
    where short documents stand together. None when even segments of one shard hold more.
    """
    if rows <= most_docs:
        return SEGMENT_SHARDS * limit
    span = max(limit, min(SEGMENT_SHARDS * limit, most_docs * total // rows))
    while True:
        counts = docs.groupBy(F.expr(f"start div {span}")).agg(F.count(F.lit(1)).alias("docs"))
        most = counts.agg(F.max("docs")).first()[0]
        if most <= most_docs:
            return span
        if span == limit:
            return None
        span = max(limit, min(span - 1, span * most_docs // most))


def max_shards(limit: int, total: int) -> int:
    """A bound on the shard count: two neighbours always hold more than the limit together."""
    return 2 * total // max(limit, 1) + 1


def next_fit_cuts(
    docs: DataFrame,
    limit: int,
    total: int,
    rows: int,
    span: int | None = None,
    segment_docs: int = SEGMENT_DOCS,
) -> DataFrame:
    """Shard ranges ``(shard_id, low, high)`` over positioned documents ``(start, end)``.

    ``total`` and ``rows`` are the stream's token and document counts, ``segment_docs`` the
    documents that may start in one task's segment. Only the two position columns are read; pass a
    stored table.
    """
    if limit <= 0:
        raise ValueError("the shard limit must be positive")
    spark = docs.sparkSession
    if total <= 0:
        return local_table(spark, [], "shard_id long, low long, high long")
    span = span or _segment_span(docs, limit, total, rows, segment_docs)
    if span is None:
        return _numbered(_doubled_cuts(docs, limit, total), SEGMENT_SHARDS * limit, total)
    count = -(-total // span)
    placed = _segments(docs.select("start", "end"), limit, span)

    if count == 1:
        entries = local_table(spark, [(0, 0)], "segment long, entry long")
    else:
        placed = materialize(placed, "segments")
        entries = _visited(placed, limit, total, span, count)

    def cuts(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        segment = int(key[0])
        stop = min((segment + 1) * span, total)
        start, jump = _jumps(docs, limit, total)
        at = int(docs["entry"].iloc[0])
        lows, highs = [], []
        while at < stop:
            lows.append(at)
            at = int(jump[np.searchsorted(start, at)])
            highs.append(at)
        return pd.DataFrame({"low": lows, "high": highs})

    listed = (
        placed.join(broadcast_if_small(entries, count), "segment")
        .groupBy("segment")
        .applyInPandas(cuts, "low long, high long")
    )
    return _numbered(settle(listed, "cuts", max_shards(limit, total)), span, total)


def _numbered(cuts: DataFrame, span: int, total: int) -> DataFrame:
    """Stored cuts with their number in the stream, counted inside segments of ``span`` tokens."""
    cuts = cuts.withColumn("segment", F.expr(f"low div {span}"))
    sizes = cuts.groupBy("segment").agg(F.count(F.lit(1)).alias("shards"))
    earlier = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "segment", F.coalesce(F.sum("shards").over(earlier), F.lit(0)).alias("offset")
    )
    ordinal = F.row_number().over(Window.partitionBy("segment").orderBy("low")) - 1
    return (
        cuts.withColumn("ordinal", ordinal)
        .join(broadcast_if_small(offsets, -(-total // span)), "segment")
        .select((F.col("offset") + F.col("ordinal")).alias("shard_id"), "low", "high")
    )


def shard_ends(docs: DataFrame, limit: int, total: int) -> DataFrame:
    """``(entry, leave)``: for every document, where a shard that opens at it closes.

    A document is put in each cell that it touches, and in the cell of its limit's end, which a
    running maximum of the starts then places in the document that holds it. No group grows with
    the limit or with the length of a document. Every document has at least one token.
    """
    span = f"sequence(start div {CELL_TOKENS}, (end - 1) div {CELL_TOKENS})"
    none = F.lit(None).cast("long").alias("entry")
    at = F.expr(f"greatest(start, cell * {CELL_TOKENS})").alias("at")
    starts = docs.select("start", F.explode(F.expr(span)).alias("cell")).select(
        "cell", at, F.col("start").alias("holder"), none
    )
    goal = F.col("start") + limit
    oversized = F.col("end") > goal
    fixed = oversized | (goal >= total)
    asked = docs.filter(~fixed).select(
        F.expr(f"(start + {limit}) div {CELL_TOKENS}").alias("cell"),
        goal.alias("at"),
        F.lit(None).cast("long").alias("holder"),
        F.col("start").alias("entry"),
    )
    # The default frame takes in rows of equal position: a start at the goal itself holds it.
    reached = F.max("holder").over(Window.partitionBy("cell").orderBy("at"))
    found = starts.unionByName(asked).withColumn("leave", reached).filter("entry is not null")
    plain = docs.filter(fixed).select(
        F.col("start").alias("entry"), F.when(oversized, F.col("end")).otherwise(total).alias("leave")
    )
    return found.select("entry", "leave").unionByName(plain)


def _doubled_cuts(docs: DataFrame, limit: int, total: int) -> DataFrame:
    """Stored ``(low, high)`` of the shards, from the jumps of all documents.

    Each of the log2(shards) rounds joins two numbers per document. A long document is where the
    jumps of many others end: such a key is hot on the side of those others alone, which Spark's
    skew join may split.
    """
    shards = max_shards(limit, total)
    first = materialize(shard_ends(docs, limit, total), "hops")
    hops = [first]
    while 1 << len(hops) < shards:
        inner = hops[-1].filter(F.col("leave") < total)
        far = hops[-1].select(F.col("entry").alias("leave"), F.col("leave").alias("_far"))
        doubled = inner.join(far, "leave").select("entry", F.col("_far").alias("leave"))
        hops.append(materialize(doubled, f"hops{len(hops)}"))
        if not hops[-1].take(1):
            break
    entries = _chain(hops, total, shards)
    cuts = first.join(broadcast_if_small(entries, shards), "entry")
    cuts = cuts.select(F.col("entry").alias("low"), F.col("leave").alias("high"))
    return settle(cuts, "cuts", shards)


def _chain(hops: list[DataFrame], total: int, bound: int) -> DataFrame:
    """``entry``: what the chain from position 0 visits, given jumps of 1, 2, 4, ... steps; at most
    ``bound`` rows.
    """
    seen = local_table(hops[0].sparkSession, [(0,)], "entry long")
    for hop in reversed(hops):
        reached = hop.join(broadcast_if_small(seen, bound), "entry").select(
            F.col("leave").alias("entry")
        )
        seen = settle(
            seen.unionByName(reached).filter(F.col("entry") < total).distinct(), "seen", bound
        )
    return seen


def _visited(placed: DataFrame, limit: int, total: int, span: int, count: int) -> DataFrame:
    """``(segment, entry)`` for each segment in which the chain opens a shard."""

    def exits(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) * span
        stop = min(low + span, total)
        start, jump = _jumps(docs, limit, total)
        leave = _exits(start, jump, stop)
        # A shard from an earlier segment ends at most one limit into this one, except after an
        # oversized document, which is followed by the first document that starts here.
        inside = (start >= low) & (start < stop)
        entry = inside & (start < low + limit)
        entry[np.flatnonzero(inside)[:1]] = True
        return pd.DataFrame({"entry": start[entry], "leave": leave[entry]})

    hop = materialize(
        placed.groupBy("segment").applyInPandas(exits, "entry long, leave long"), "hops"
    )
    hops = [hop]
    while 1 << len(hops) < count:
        far = hops[-1].select(F.col("entry").alias("leave"), F.col("leave").alias("_far"))
        doubled = hops[-1].join(far, "leave").select("entry", F.col("_far").alias("leave"))
        hops.append(materialize(doubled, f"hops{len(hops)}"))
    seen = _chain(hops, total, count)
    return seen.select(F.expr(f"entry div {span}").alias("segment"), "entry")


def assign_shards(
    docs: DataFrame, cuts: DataFrame, limit: int, shards: int, start: str = "start"
) -> DataFrame:
    """Add ``shard_id`` to positioned documents."""
    return interval_lookup(docs, cuts, start, "low", "high", limit, shards, ["shard_id"])


def shards_by_quotient(docs: DataFrame, limit: int) -> DataFrame:
    """Approximate packing: the shard is the quotient of the start by the limit. A shard may
    exceed the limit by less than one document.
    """
    return docs.withColumn("shard_id", F.expr(f"start div {limit}"))
