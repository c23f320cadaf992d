"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (a, b)``: the smallest node that it reaches.

    Alternates two steps until nothing changes: every node links its larger neighbours to the
    smallest of its neighbourhood, then its smaller neighbours likewise. Both are an aggregate with
    map-side combine and a plain join, so a node with very many links is split like any other; the
    number of rounds grows with the logarithm of the number of nodes. Each round is a stage table.
    """
    links = links.filter(F.col("a") != F.col("b"))
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    counts = links.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
    chained = links.join(links.select(F.col("b").alias("a")), "a", "left_semi")
    # Links that are stars already need no round.
    stars = counts[0] == counts[1] and chained.isEmpty()
    before = None
    while not stars:
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter(F.col("b") > F.col("a")).join(least, "a")
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        joined = moved.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionAll(joined.select("a", F.col("m").alias("b")))
        links = materialize(moved.filter(F.col("a") != F.col("b")).distinct(), "links")
        state = links.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")
        ).first()
        if state == before:
            break
        before = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
