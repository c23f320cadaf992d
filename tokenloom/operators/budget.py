"""Token budgets per source: cut-off search, selection, truncation, mixture and reports.

The running total over a source decides which documents are kept, but only one document per source
needs to be found: the one at which the total reaches the target. Everything before it is kept
whole and everything after it is dropped, so selection is a filter with no shuffle. The document
is found by a histogram descent over the order column, each step one aggregate with map-side
combine; no step sorts a source or brings it to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.session import broadcast_if_small, local_table, settle

# Histogram bins per source and step.
FANOUT = 16_384


def mixture(spark: SparkSession, targets: dict[str, int]) -> DataFrame:
    """The mixture as a table ``(source, target_tokens)``."""
    rows = [(source, int(tokens)) for source, tokens in targets.items()]
    return local_table(spark, rows, "source string, target_tokens long")


def budget_cutoffs(counted: DataFrame, spec: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per source of ``spec``: ``target_tokens, available_tokens, written_tokens``, the
    last kept ``cut_seq`` (null when nothing is kept) and ``cut_tokens``, the tokens kept of it.

    ``counted`` is ``(source, seq, n_tokens)``; ``seq`` is the input order, unique in a source.
    It is scanned once per step, so pass a stored table when counting is expensive.
    """
    if "seq" not in counted.columns:
        raise ValueError("budgets follow input order: the input needs a seq column")
    counted = counted.select("source", "seq", "n_tokens").filter(F.col("n_tokens") > 0)
    sources = spec.count()
    targets = broadcast_if_small(spec, sources)
    found = (
        counted.join(targets, "source")
        .groupBy("source")
        .agg(
            F.sum("n_tokens").alias("available"),
            F.min("seq").alias("low"),
            F.max("seq").alias("high"),
        )
    )
    reach = (
        spec.join(found, "source", "left")
        .withColumn("available_tokens", F.coalesce("available", F.lit(0)))
        .withColumn(
            "goal", F.greatest(F.least("target_tokens", "available_tokens"), F.lit(0).cast("long"))
        )
    )
    reach = settle(reach, "reach", sources)
    span = reach.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 1
    state = reach.filter(F.col("goal") > 0).select(
        "source", "goal", "low", "high", F.lit(0).cast("long").alias("before")
    )
    width = span
    while True:
        width = -(-width // fanout)
        state = _descend(counted, state, width, sources)
        if width == 1:
            break
        state = settle(state, "descent", sources)
    cut = state.select(
        "source",
        F.when(F.col("rows") == 1, F.col("low"))
        .otherwise(F.raise_error(F.lit("seq repeats inside a source")).cast("long"))
        .alias("cut_seq"),
        (F.col("goal") - F.col("before")).alias("cut_tokens"),
    )
    return reach.join(broadcast_if_small(cut, sources), "source", "left").select(
        "source",
        "target_tokens",
        "available_tokens",
        F.col("goal").alias("written_tokens"),
        "cut_seq",
        "cut_tokens",
    )


def _descend(counted: DataFrame, state: DataFrame, width: int, sources: int) -> DataFrame:
    """Narrow each source's range to the bin of ``width`` in which the total reaches the goal."""
    inside = counted.join(broadcast_if_small(state, sources), "source").filter(
        (F.col("seq") >= F.col("low")) & (F.col("seq") <= F.col("high"))
    )
    bins = (
        inside.withColumn("bin", F.expr(f"(seq - low) div {width}"))
        .groupBy("source", "goal", "low", "before", "bin")
        .agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    )
    running = Window.partitionBy("source").orderBy("bin")
    through = F.col("before") + F.sum("tokens").over(
        running.rowsBetween(Window.unboundedPreceding, 0)
    )
    # Exactly one bin per source takes the total from below the goal to it.
    reached = bins.withColumn("through", through).filter(
        (F.col("through") >= F.col("goal"))
        & (F.col("through") - F.col("tokens") < F.col("goal"))
    )
    start = F.col("low") + F.col("bin") * F.lit(width)
    return reached.select(
        "source",
        "goal",
        start.alias("low"),
        (start + F.lit(width - 1)).alias("high"),
        (F.col("through") - F.col("tokens")).alias("before"),
        "rows",
    )


def budget_select(counted: DataFrame, cutoffs: DataFrame, sources: int | None = None) -> DataFrame:
    """Kept documents with ``kept_tokens`` and ``is_truncated``; other columns pass through."""
    sources = cutoffs.count() if sources is None else sources
    cut = cutoffs.filter("cut_seq is not null").select("source", "cut_seq", "cut_tokens")
    at_cut = F.col("seq") == F.col("cut_seq")
    kept = counted.filter(F.col("n_tokens") > 0).join(broadcast_if_small(cut, sources), "source")
    kept = kept.filter(F.col("seq") <= F.col("cut_seq")).withColumn(
        "kept_tokens", F.when(at_cut, F.col("cut_tokens")).otherwise(F.col("n_tokens"))
    )
    return kept.withColumn("is_truncated", F.col("kept_tokens") < F.col("n_tokens")).drop(
        "cut_seq", "cut_tokens"
    )


def truncate_text(selected: DataFrame, tokenizer) -> DataFrame:
    """Replace the text of each cut document by the text of its kept tokens.

    Cut documents are at most one per source; the others pass in the same scan and reach the
    tokenizer as nulls.
    """
    text = F.when(F.col("is_truncated"), F.col("text"))
    cut = tokenizer.cut(text, F.col("kept_tokens"))
    return selected.withColumn("text", F.when(F.col("is_truncated"), cut).otherwise(F.col("text")))


def budget_report(cutoffs: DataFrame) -> DataFrame:
    """Tokens written per source of the mixture, the shortfall, and whether the source ran out."""
    shortfall = F.greatest(F.col("target_tokens") - F.col("written_tokens"), F.lit(0))
    return cutoffs.select(
        "source",
        "target_tokens",
        "available_tokens",
        "written_tokens",
        shortfall.alias("shortfall"),
        (F.col("written_tokens") < F.col("target_tokens")).alias("ran_out"),
    )


def mix_share(cutoffs: DataFrame) -> DataFrame:
    """Each source's share of all written tokens, next to the share its target asks for."""
    totals = cutoffs.agg(
        F.sum("written_tokens").alias("w"), F.sum(F.greatest("target_tokens", F.lit(0))).alias("t")
    ).first()
    written, target = totals["w"] or 0, totals["t"] or 0
    share = lambda column, total: (
        F.greatest(F.col(column), F.lit(0)) / F.lit(float(total)) if total else F.lit(0.0)
    )
    return cutoffs.select(
        "source",
        "written_tokens",
        share("written_tokens", written).alias("share"),
        share("target_tokens", target).alias("target_share"),
    )
