"""Zone maps of corpora: what each file holds, known only as far as a budget asks.

A budget takes documents in file order, so files past the one in which the target is met are never
needed. Files are counted in rounds, all sources together: the files of the next round are as many
as the tokens per file so far suggest, at most as many as were counted before.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.operators.clean import MAX_TOKEN_COUNT, is_kept, skip_reason
from tokenloom.session import local_table, materialize
from tokenloom.sources.corpus import ROW_BITS, Paths, corpus_files, scan_corpus

ZONES = (
    "source string, file string, number long, docs long, bytes long, tokens long, "
    "low_seq long, high_seq long"
)


@dataclass(frozen=True)
class Counted:
    """Stored counts ``(source, seq, n_tokens, reason)`` of the files opened, the zone map
    (``ZONES``) of the same files, the files that the targets need, by source and in order, and
    ``(source, ended)``: whether a source was read to its end.
    """

    counts: DataFrame
    zones: DataFrame
    files: dict[str, list[str]]
    ended: DataFrame


def next_files(opened: int, left: int, tokens: int, target: int) -> int:
    """Files to open next, of ``left``, when ``opened`` ones held ``tokens`` of ``target``."""
    if tokens >= target or not left:
        return 0
    if not opened or not tokens:
        return min(left, max(1, opened))
    need = -(-(target - tokens) * opened // tokens)
    return min(left, max(1, min(need, opened)))


def count_until_met(
    spark: SparkSession,
    paths: Mapping[str, Paths],
    spec: DataFrame,
    tokenizer,
    max_tokens: int = MAX_TOKEN_COUNT,
    file_format: str = "parquet",
    text: str = "text",
) -> Counted:
    """Count the mixture's sources file by file until their targets are met.

    The driver holds the listing, a target per source and a line per opened file; documents are
    counted and stored by the tasks. Datasets that are not in ``spec`` are not opened.
    """
    targets = {r["source"]: r["target_tokens"] for r in spec.collect()}
    listing = {
        s: corpus_files(spark, path, file_format) if targets[s] > 0 else []
        for s, path in paths.items()
        if s in targets
    }
    tokens, opened = dict.fromkeys(listing, 0), dict.fromkeys(listing, 0)
    zones: list[tuple] = []
    counts = None
    while True:
        step = {
            s: n
            for s in listing
            if (n := next_files(opened[s], len(listing[s]) - opened[s], tokens[s], targets[s]))
        }
        if not step:
            break
        found = None
        for source, n in step.items():
            own = listing[source][opened[source] : opened[source] + n]
            part = scan_corpus(spark, {source: own}, text, file_format)
            base = opened[source] << ROW_BITS
            part = part.withColumn("seq", F.col("seq") + F.lit(base))
            found = part if found is None else found.unionByName(part)
        counted = found.withColumn("n_tokens", tokenizer.count(F.col("text")))
        reason = skip_reason(F.col("text"), F.col("n_tokens"), max_tokens)
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        counted = materialize(
            counted.select("source", "seq", "n_tokens", reason.alias("reason"), size.alias("bytes")),
            "zone-counts",
        )
        known = _zones(counted)
        for source, n in step.items():
            for number in range(opened[source], opened[source] + n):
                row = known.get((source, number), (0, 0, 0, None, None))
                zones.append((source, listing[source][number], number, *row))
                tokens[source] += row[2]
            opened[source] += n
        counts = counted if counts is None else counts.unionByName(counted)
    if counts is None:
        empty = "source string, seq long, n_tokens long, reason string, bytes long"
        counts = local_table(spark, [], empty)
    ended = [(s, s not in listing or opened[s] == len(listing[s])) for s in targets]
    return Counted(
        counts.drop("bytes"),
        local_table(spark, zones, ZONES),
        {s: _needed(s, listing[s], zones, targets[s]) for s in listing},
        local_table(spark, ended, "source string, ended boolean"),
    )


def _zones(counted: DataFrame) -> dict[tuple[str, int], tuple]:
    """One line per file of a round."""
    rows = (
        counted.groupBy("source", F.shiftright("seq", ROW_BITS).alias("number"))
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.sum("bytes").alias("bytes"),
            F.coalesce(F.sum(F.when(is_kept(), F.col("n_tokens"))), F.lit(0)).alias("tokens"),
            F.min("seq").alias("low_seq"),
            F.max("seq").alias("high_seq"),
        )
        .collect()
    )
    return {
        (r["source"], r["number"]): (r["docs"], r["bytes"], r["tokens"], r["low_seq"], r["high_seq"])
        for r in rows
    }


def _needed(source: str, files: list[str], zones: list[tuple], target: int) -> list[str]:
    """The files up to the one in which the target is met."""
    held = {z[2]: z[5] for z in zones if z[0] == source}
    total, needed = 0, []
    for number, file in enumerate(files):
        if total >= target or number not in held:
            break
        needed.append(file)
        total += held[number]
    return needed


def needed_zones(zones: DataFrame, spec: DataFrame) -> DataFrame:
    """The zones up to the one in which each source's target is met, with ``tokens_before``."""
    by_file = Window.partitionBy("source").orderBy("number")
    before = F.sum("tokens").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    placed = zones.withColumn("tokens_before", F.coalesce(before, F.lit(0)))
    return placed.join(spec, "source").filter("tokens_before < target_tokens")
