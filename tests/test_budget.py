import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from models import take_budget
from tokenloom.functions.tokenizers import Utf8ByteTokenizer
from tokenloom.operators.budget import (
    budget_cutoffs,
    budget_report,
    budget_select,
    mix_share,
    mixture,
    truncate_text,
)
from tokenloom.operators.clean import kept_documents

TOK = Utf8ByteTokenizer()


def documents(spark, docs):
    rows = [(s, q, t) for s, items in docs.items() for q, t in items]
    df = spark.createDataFrame(rows, "source string, seq long, text string")
    return kept_documents(df.repartition(3), TOK.count(F.col("text")))


def run(spark, docs, targets, fanout=16_384):
    counted = documents(spark, docs)
    cutoffs = budget_cutoffs(counted, mixture(spark, targets), fanout)
    kept = truncate_text(budget_select(counted, cutoffs), TOK)
    rows = kept.select("source", "seq", "kept_tokens", "text").collect()
    found = {s: [] for s in targets}
    for r in sorted(rows):
        found[r["source"]].append((r["seq"], r["kept_tokens"], r["text"]))
    return found, cutoffs


# Byte tokens with the separator: "aa" is 3, "bbb" is 4, "é" is 3.
DOCS = {"A": [(1, "aa"), (2, "bbb"), (5, "é"), (9, "cccc")]}


TARGETS = [0, -3, 1, 2, 3, 4, 6, 7, 8, 9, 10, 14, 15, 16, 100]


@pytest.mark.parametrize("fanout", [4, 16_384])
def test_every_kind_of_target(spark, fanout):
    docs = {f"A{t}": DOCS["A"] for t in TARGETS}
    found, _ = run(spark, docs, {f"A{t}": t for t in TARGETS}, fanout)
    for target in TARGETS:
        assert found[f"A{target}"] == take_budget(DOCS["A"], target)


def test_sources_missing_exact_and_short(spark):
    docs = DOCS | {"B": [(0, "x")], "unused": [(0, "y")]}
    _, cutoffs = run(spark, docs, {"A": 7, "B": 10, "C": 5})
    report = {r["source"]: r for r in budget_report(cutoffs).collect()}
    assert {s: (r["written_tokens"], r["shortfall"], r["ran_out"]) for s, r in report.items()} == {
        "A": (7, 0, False),
        "B": (2, 8, True),
        "C": (0, 5, True),
    }
    shares = {r["source"]: (r["share"], r["target_share"]) for r in mix_share(cutoffs).collect()}
    assert shares["A"] == pytest.approx((7 / 9, 7 / 22))
    assert shares["C"] == pytest.approx((0.0, 5 / 22))


def test_wide_and_clustered_order_columns(spark):
    """A third of a source sits in one narrow range, the rest is spread over 2^50."""
    rng = random.Random(7)
    seqs = sorted({rng.randrange(1 << 50) for _ in range(200)} | set(range(5_000, 5_100)))
    docs = {"A": [(q, "x" * rng.randrange(1, 30)) for q in seqs]}
    total = sum(len(t) + 1 for _, t in docs["A"])
    targets = {str(t): t for t in (1, total // 5, total // 2, total - 1, total, total + 5)}
    docs = {name: docs["A"] for name in targets}
    found, cutoffs = run(spark, docs, targets, fanout=256)
    for name, target in targets.items():
        assert found[name] == take_budget(docs[name], target)


def test_order_column_is_required_and_unique(spark):
    df = spark.createDataFrame([("A", 1)], "source string, n_tokens long")
    with pytest.raises(ValueError, match="seq"):
        budget_cutoffs(df, mixture(spark, {"A": 1}))
    twice = spark.createDataFrame([("A", 1, 5), ("A", 1, 5), ("A", 2, 5)], "source string, seq long, n_tokens long")
    with pytest.raises(Exception, match="seq repeats"):
        budget_cutoffs(twice, mixture(spark, {"A": 3})).collect()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.sampled_from(["A", "B", "C"]),
        st.lists(st.text(st.characters(codec="utf-8"), min_size=0, max_size=12), max_size=12),
        min_size=1,
    ),
    st.integers(0, 120),
)
def test_budget_properties(spark, texts, target):
    docs = {s: [(i * 3, t) for i, t in enumerate(ts)] for s, ts in texts.items()}
    found, cutoffs = run(spark, docs, {s: target for s in docs}, fanout=5)
    for source, items in docs.items():
        expected = take_budget([d for d in items if d[1]], target)
        assert found[source] == expected
        available = sum(len(t.encode()) + 1 for _, t in items if t)
        assert sum(k for _, k, _ in found[source]) == min(target, available)


def test_no_task_receives_a_whole_source(spark):
    """The selection is a filter: documents are not exchanged, sorted or windowed."""
    counted = documents(spark, DOCS)
    cutoffs = budget_cutoffs(counted, mixture(spark, {"A": 5}))
    from tokenloom.session import materialize

    stored, cut = materialize(counted, "t"), materialize(cutoffs, "t")
    plan = budget_select(stored, cut, 1)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Window" not in physical and "Sort" not in physical
    assert "hashpartitioning" not in physical and "SinglePartition" not in physical
