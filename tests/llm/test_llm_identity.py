"""Different texts whose first hashes are equal."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.llm import substring_dedup


def _expected(rows, length=50):
    """``(doc_id, n_bytes, n_removed, kept_sha256)`` by looking at every string of every text."""
    data = [(i, (text or "").encode()) for i, text in rows]
    first: dict[bytes, int] = {}
    for i, text in sorted(data):
        for at in range(len(text) - length + 1):
            first.setdefault(text[at : at + length], i)
    out = []
    for i, text in data:
        gone = set()
        for at in range(len(text) - length + 1):
            if first[text[at : at + length]] < i:
                gone.update(range(at, at + length))
        kept = bytes(b for at, b in enumerate(text) if at not in gone)
        out.append((i, len(text), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("ids", [1, 4])
def test_texts_of_one_hash_are_told_apart(spark, monkeypatch, ids):
    """The first hash takes one value, or four, so that long texts, short ones, copies and nulls
    all share an id.
    """
    rng = random.Random(ids)
    words = [f"word{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(25)]
    texts += [texts[3], texts[3] + "!", texts[9] + shared, shared + texts[12], shared, "", None, "a"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    some = lambda text: F.pmod(F.xxhash64(text), F.lit(ids))
    monkeypatch.setattr(substring_dedup, "first_hash", some)
    found = substring_dedup.deduplicate(docs)
    found = found.select("doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == _expected(rows)
