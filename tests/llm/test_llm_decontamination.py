"""Decontamination: bounded memory, parts at every offset, short items."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tokenloom.llm import decontamination
from tokenloom.llm.decontamination import ItemIndex, drop_leaks, find_leaks, search


def _found(index, texts):
    return {(row, item) for row, item, *_ in search(index, pa.array(texts))}


def test_text_of_dashes():
    index = ItemIndex.build([(1, b"a title " + b"-" * 300 + b" and a body of text")])
    text = "x" * 100 + "-" * 20_000 + " end"
    tracemalloc.start()
    rows = list(search(index, pa.array([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r[0], r[1], r[4]) for r in rows] == [(0, 1, 0)]
    # From the first of them to the last; a near copy of their edge may reach a few bytes further.
    assert 90 <= rows[0][2] <= 100 and 20_100 <= rows[0][3] <= len(text)
    assert peak < 300 << 20


@pytest.mark.parametrize("size", [80, 97, 128, 129, 150, 200])
def test_parts_of_items(size):
    rng = np.random.default_rng(size)
    item = "".join(rng.choice(list("abcdefghijklmnop"), size))
    index = ItemIndex.build([(7, item.encode())])
    for long in range(decontamination.FRAGMENT, size + 1, 11):
        texts = ["qrs " * 9 + item[low : low + long] + " tuv" * 9 for low in range(size - long + 1)]
        assert _found(index, texts) == {(row, 7) for row in range(len(texts))}


def test_slices_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    prose = lambda n: "".join(rng.choice(list("ab "), n))
    items = [(i, prose(int(n)).encode()) for i, n in enumerate(rng.integers(10, 300, 12))]
    index = ItemIndex.build(items)
    texts = [prose(200) + items[i % 12][1].decode()[3:] + prose(50) for i in range(24)]
    want = sorted(search(index, pa.array(texts)))
    monkeypatch.setattr(decontamination, "SLICE_RUNS", 50)
    monkeypatch.setattr(decontamination, "SLICE_PAIRS", 30)
    again = sorted(search(index, pa.array(texts)))
    assert want and [r[:2] for r in again] == [r[:2] for r in want]
    assert [r[4] for r in again] == [r[4] for r in want]


def test_short_items(spark):
    items = [(1, "What is  the CAPITAL of France?"), (2, "blue whales eat k"), (3, "yes"), (4, "Ünit")]
    index = ItemIndex.build([(i, t.encode()) for i, t in items])
    texts = [
        "He asked: what is the capital of france? Then left.",
        "what is the capital of frances?",  # a longer word
        "xblue whales eat k",
        "(blue whales eat k)",
        "blue whales ate k",
        "Yes, please",
        "yesterday",
        "eyes",
        "yes",
        "ünit",
        "",
        None,
    ]
    assert _found(index, texts) == {(0, 1), (3, 2), (5, 3), (8, 3)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, benchmark).collect()}
    assert set(rows) == {(0, 1), (3, 2), (5, 3), (8, 3)}
    assert (rows[0, 1]["span_start"], rows[0, 1]["span_end"]) == (10, 40)
    # Items of one word drop nothing.
    left = {r["doc_id"] for r in drop_leaks(docs, benchmark).collect()}
    assert left == set(range(len(texts))) - {0, 3}
