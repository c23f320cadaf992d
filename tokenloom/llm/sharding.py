"""Sharding by a Feistel permutation of global row numbers.

A row's global number is its place in storage: the rows of all earlier files plus its index in its
own file. Both come from the scan, so numbering shuffles nothing and no key, copy or source can be
hot. The number then goes through a keyed permutation of [0, N); shard and slot are arithmetic on
the result, so either can be computed for any row alone, and a rerun over the same files gives the
same shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.session import materialize

ROUNDS = 8
# Files whose offsets are broadcast (at most some 200 bytes each); more are joined by a shuffle.
BROADCAST_FILES = 50_000
# Fixed values of the round function: odd 31-bit multipliers and a prime below 2^31.
MULTIPLY_A = 1_540_483_477
MULTIPLY_B = 1_103_515_245
PRIME = 2_147_483_647
# Steps of one walk; a walk that needs more goes on in a longer one.
SHORT_WALK, LONG_WALK = 64, 1_000_000


def sides(rows: int) -> tuple[int, int]:
    """The two halves' sizes: their product is the least rectangle near a square that holds
    ``rows``, so fewer than sqrt(rows) numbers lie outside and walks are rare.
    """
    left = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return left, max(1, -(-rows // left))


def round_keys(seed: int, rows: int) -> list[tuple[int, int, int]]:
    """(key, key, modulus) of each round; the halves swap roles from round to round."""
    left, right = sides(rows)
    keys = []
    state = seed % PRIME
    for number in range(ROUNDS):
        state = (state * 48_271 + 11 + number) % PRIME
        first = state
        state = (state * 48_271 + 11 + number) % PRIME
        keys.append((first, state, left if number % 2 == 0 else right))
    return keys


def divide(number: Column, by: int) -> Column:
    """Whole division of longs."""
    return F.call_function("div", number, F.lit(by).cast("long"))


def permute(number: Column, rows: int, seed: int) -> Column:
    """The place of a row number in the shuffled order of ``rows`` rows."""
    right = sides(rows)[1]
    keys = F.array(
        *[
            F.struct(
                F.lit(a).cast("long").alias("a"),
                F.lit(b).cast("long").alias("b"),
                F.lit(m).cast("long").alias("m"),
            )
            for a, b, m in round_keys(seed, rows)
        ]
    )

    def feistel(x: Column) -> Column:
        def turn(state: Column, key: Column) -> Column:
            hashed = ((state["r"] * MULTIPLY_A + key["a"]) % PRIME) * MULTIPLY_B + key["b"]
            moved = (state["l"] + F.shiftright(hashed, 16)) % key["m"]
            return F.struct(state["r"].alias("l"), moved.alias("r"))

        start = F.struct(divide(x, right).alias("l"), (x % right).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s["l"] * right + s["r"])

    def walk(x: Column, steps: int) -> Column:
        """Cycle walking: permute again until the number lies inside."""
        turns = F.when(x < rows, F.array().cast("array<int>")).otherwise(
            F.sequence(F.lit(1), F.lit(steps))
        )
        return F.aggregate(
            turns, x, lambda at, _: F.when(at < rows, at).otherwise(feistel(at))
        )

    return walk(walk(feistel(number), SHORT_WALK), LONG_WALK)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with its place in storage as ``_file``, ``_index`` and ``_before`` (rows of the
    earlier files), and the number of rows. Rows that are not whole stored files (derived or
    filtered rows) are written as a stage table first.
    """
    stored = docs
    for attempt in range(2):
        try:
            placed = stored.select(
                "*",
                F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.row_index").alias("_index"),
            )
            files = placed.groupBy("_file").agg(
                F.count(F.lit(1)).alias("rows"), (F.max("_index") + 1).alias("reach")
            )
            found = files.agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                F.count(F.lit(1)).alias("files"),
                F.coalesce(F.sum(F.col("reach") - F.col("rows")), F.lit(0)).alias("gaps"),
            ).first()
        except Exception as error:  # no storage columns behind these rows
            if attempt or "_metadata" not in str(error):
                raise
            found = None
        if found is not None and found["gaps"] == 0:
            break
        stored = materialize(docs, "unnumbered")
    # One row per file; the window orders files, never documents.
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("_file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_before"))
    if found["files"] <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, "_file"), found["rows"]


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Deal all rows to ``shards`` shards under the law ``rows``: counts differ by one at most.

    Input: ``doc_id``, ``text``; other columns are ignored whatever their names. Output, one row
    per input row: ``doc_id, size`` (UTF-8 bytes + 1), ``text_crc32, law, shard, slot``
    (gapless from 0 in each shard), ``grown_shard`` (null under this law).

    Defined cases: a null text has no bytes (size 1, crc32 0) and so has an empty one; a null or
    repeated ``doc_id`` and equal rows change nothing, as rows are told apart by their place in
    storage; long texts are read once; an empty table gives an empty result.
    """
    rows_in, rows = numbered(docs.select("doc_id", "text"))
    place = permute(F.col("_before") + F.col("_index"), rows, seed)
    placed = rows_in.select("doc_id", "text", place.alias("place"))
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        divide(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
