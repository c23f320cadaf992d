"""Runs that share a cache, and searches that hold one block of queries at a time."""

import threading

import numpy as np
import public_tokenizers
import pytest

from tokenloom.llm import topk
from tokenloom.llm.token_counts import TokenizerFile, append_counts, count_tokens, open_cache


def test_two_runs_share_a_cache(spark, out):
    """Two runs at once, with half of their texts in common, on a cache that is not there yet."""
    tokenizer = TokenizerFile(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"document {i} of a shared cache" for i in range(300)]
    tables = [
        spark.createDataFrame(list(enumerate(part)), "doc_id long, text string").repartition(3)
        for part in (texts[:200], texts[100:])
    ]
    expected = [list(enumerate(tokenizer.lengths(part))) for part in (texts[:200], texts[100:])]
    found: dict[int, list] = {}

    def run(number: int) -> None:
        counted = count_tokens(tables[number], tokenizer, out + "/cache")
        found[number] = sorted((r["doc_id"], r["n_tokens"]) for r in counted.collect())

    threads = [threading.Thread(target=run, args=(i,)) for i in (0, 1)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert [found.get(i) for i in (0, 1)] == expected
    kept = open_cache(spark, out + "/cache", tokenizer.version())
    assert kept.select("digest").distinct().count() == 300


def test_an_append_between_the_lookup_and_the_write(spark, out):
    """Rows that another run commits meanwhile stay, and both runs' rows are read."""
    one = spark.createDataFrame([(bytearray(b"a"), 1)], "digest binary, n_tokens long")
    two = spark.createDataFrame([(bytearray(b"b"), 2)], "digest binary, n_tokens long")
    append_counts(one, out + "/cache", "v")
    before = open_cache(spark, out + "/cache", "v")
    append_counts(two, out + "/cache", "v")
    assert before.count() == 1
    assert sorted(r["n_tokens"] for r in open_cache(spark, out + "/cache", "v").collect()) == [1, 2]
    assert open_cache(spark, out + "/cache", "w").count() == 0


def test_a_lost_count_is_an_error(spark, out, monkeypatch):
    """As if the rows of this run had gone with their folder."""
    from tokenloom.llm import token_counts

    tokenizer = TokenizerFile(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, "one text"), (2, "another")], "doc_id long, text string")

    monkeypatch.setattr(token_counts, "append_counts", lambda *_: None)
    with pytest.raises(Exception, match="missing from the cache"):
        count_tokens(docs, tokenizer, out + "/cache").collect()


def _expected(rows, every, k=10):
    whole = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows}
    out = []
    for query in (i for i in whole if i % every == 0):
        scores = sorted((-int(whole[query] @ v), i) for i, v in whole.items() if i != query)
        out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_one_block_of_queries_at_a_time(spark, monkeypatch):
    """Every block is searched and written before the next one is fetched."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * 6 * 4)
    steps = []
    search, write = topk._search, topk.materialize
    monkeypatch.setattr(topk, "_search", lambda *a: steps.append("search") or search(*a))
    monkeypatch.setattr(topk, "materialize", lambda df, n: steps.append(n) or write(df, n))
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = sorted(map(tuple, topk.top_k(df, every=20).collect()))
    assert found == _expected(rows, 20)
    assert steps == ["vectors"] + ["search", "top-k"] * 3


def test_short_vectors_are_not_scanned(spark, monkeypatch):
    """Where lengths are skewed, the least length a query can use passes over the stored tail."""
    least = []
    norm = topk.Queries.least_norm
    monkeypatch.setattr(topk.Queries, "least_norm", lambda q: least.append(norm(q)) or least[-1])
    rng = np.random.default_rng(5)
    base = np.abs(rng.normal(size=(400, 6)))
    base[40:] *= 1e-3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df, every=100).collect())) == _expected(rows, 100)
    norms = [float((np.floor(1024 * v) ** 2).sum()) for v in base]
    assert sum(n >= least[0] for n in norms) < 60
