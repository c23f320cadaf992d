"""Nulls, empty and long texts, ties and repeats, empty tables and clashing columns."""

import base64
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from tokenloom.llm import pieces
from tokenloom.llm.decontamination import drop_leaks, find_leaks
from tokenloom.llm.jaccard_join import jaccard_components, keep_one
from tokenloom.llm.language_id import identify, keep_identified
from tokenloom.llm.quality import classify, keep_good
from tokenloom.llm.sharding import shard_rows
from tokenloom.llm.substring_dedup import deduplicate, keep_unrepeated
from tokenloom.llm.token_counts import TokenizerFile, count_tokens, open_cache
from tokenloom.llm.token_files import token_files
from tokenloom.llm.topk import top_k

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and then runs on to the far green hills "
LONG = PROSE * 3000
ROWS = [
    (None, None, None, None, None),
    (None, PROSE, "en", "s", 1),
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t", None, "s", 3),
    (4, "123 456", "en", "s", 7),
    (5, "Hi", "en", None, 2),
    (6, PROSE + "x", "en", "s", 1),
    (7, PROSE + "x", "en", "s", 1),
    (7, PROSE + "x", "en", "s", 1),
    (8, "le petit chat est sur la table avec des amis et du pain", "fr", "s", 1),
    (9, LONG, "en", "s", 1),
    (10, "x" * 200_000, "en", "s", 1),
    (10, "two rows share this id", "en", "s", 1),
]
# Names that the operators use for columns of their own.
CLASHES = ["h", "n", "rank", "text_id", "set_id", "c0", "kept", "digest", "place", "score", "ids"]
SIZE = {i: len((r[1] or "").encode()) for i, r in enumerate(ROWS)}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "short"), (None, PROSE)]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("h", F.lit(0))


def _ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


ALL_IDS = sorted((r[0] for r in ROWS), key=repr)


def test_sharding(docs, none):
    rows = shard_rows(docs).collect()
    assert sorted(map(repr, (r["doc_id"] for r in rows))) == sorted(map(repr, ALL_IDS))
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    for shard in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    assert sorted(r["size"] for r in rows) == sorted(n + 1 for n in SIZE.values())
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((r[1] or "").encode()) for r in ROWS}
    assert shard_rows(none).collect() == []


def test_sharding_repeats(spark, out):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).repartition(
        7
    ).write.parquet(out + "/t")
    first, second = (shard_rows(spark.read.parquet(out + "/t"), seed=5).collect() for _ in range(2))
    assert sorted(first) == sorted(second)
    assert sorted(first) != sorted(shard_rows(spark.read.parquet(out + "/t"), seed=6).collect())
    part = spark.read.parquet(out + "/t").filter("doc_id % 3 = 0")
    assert sorted(r["slot"] for r in shard_rows(part, shards=1).collect()) == list(range(334))


def test_language_id(docs, none):
    rows = identify(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "fr"}
    pred = {r["doc_id"]: r["lang_pred"] for r in rows}
    letters = {r[0] for r in ROWS if r[1] and any(c.isalpha() for c in r[1])}
    assert all(pred[d] != "und" for d in letters)
    assert set(_ids(keep_identified(docs))) <= letters
    assert keep_identified(docs).columns == docs.columns
    assert identify(none).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}


def test_language_id_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    letters = np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz   "), (6, 400))
    junk = ["".join(row) for row in letters] + ["".join(letters[0])[:40], "Это", "Это простой текст на русском языке. " * 9]
    junk += ["这是一个中文句子，" * 20, np.random.default_rng(5).bytes(300).hex()]
    junk += [base64.b64encode(np.random.default_rng(6).bytes(300)).decode()]
    words = [r["text"].split() for r in docs.filter("text is not null").collect()]
    clean = [" ".join(w[:n]) for w in words for n in (2, 5, 30) if len(w) >= n]
    clean = [c for c in clean if any(x.isalpha() for x in c)]
    more = [(-1 - i, t, None) for i, t in enumerate([*junk, *clean])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    kept = set(_ids(keep_identified(docs)))
    assert not kept & set(range(-len(junk), 0))
    assert kept >= {i for i, _, _ in more[len(junk) :]}
    assert kept >= {r["doc_id"] for r in docs.filter("doc_id >= 0 and text is not null").collect()}
    # Identification itself answers for every text with a letter, whatever it is.
    found = {r["doc_id"]: r for r in identify(docs).collect()}
    for i, _, _ in more:
        assert found[i]["lang_pred"] in ("en", "de", "fr", "es") and 0 <= found[i]["score"] <= 1


def test_jaccard(docs, none):
    rows = jaccard_components(docs).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)
    words = len(PROSE.split())
    size, more = words - 4, words - 3
    # PROSE repeated has a shingle for every place of the period, too many to be near PROSE.
    assert 100 * size < 80 * words and 100 * size >= 80 * more
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 5), 8: (9, 8), 9: (words, 9)}
    assert {d: (n, c) for d, n, c in got if d in want} == want
    assert [g for g in got if g[0] in (6, 7)] == [(6, more, 6), (7, more, 6), (7, more, 6)]
    assert (None, 0, None) in got and (None, size, 6) in got
    assert sorted(g for g in got if g[0] == 10) == [(10, 1, 10), (10, 1, 10)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert _ids(kept) == sorted([None, None, 1, 2, 3, 4, 5, 6, 8, 9, 10, 10], key=repr)
    assert jaccard_components(none).collect() == []
    assert keep_one(none).collect() == []


def test_jaccard_null_id_among_copies(spark):
    rows = [(None, PROSE), (7, PROSE), (5, PROSE), (9, PROSE + "x"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect()), key=repr)
    assert found == sorted([(None, 5), (7, 5), (5, 5), (9, 5), (None, None)], key=repr)
    assert _ids(keep_one(docs)) == [5, None, None]


def test_substrings(docs, none):
    rows = deduplicate(docs).collect()
    assert sorted(r["n_bytes"] for r in rows) == sorted(SIZE.values())
    removed = sorted(((r["doc_id"], r["n_removed"], r["n_spans"]) for r in rows), key=repr)
    whole = len(PROSE) + 1
    assert [r for r in removed if r[0] in (6, 7)] == [(6, 0, 0), (7, whole, 1), (7, whole, 1)]
    assert (None, len(PROSE), 1) in removed and (None, 0, 0) in removed
    assert (10, 0, 0) in removed and (9, len(LONG) - 1, 1) not in removed
    kept = keep_unrepeated(docs)
    assert kept.columns == docs.columns
    texts = {(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()}
    assert (None, None, None) in texts and (7, "", 0) in texts and (5, "Hi", 2) in texts
    assert deduplicate(none).collect() == [] and keep_unrepeated(none).collect() == []


def test_cut_characters(spark):
    head = "é" * 24 + "abc"
    docs = spark.createDataFrame([(1, head), (2, "x" + head[1:] + "é")], "doc_id long, text string")
    # Bytes of the string that both share begin inside no character here; cut one byte further.
    kept = {r["doc_id"]: r["text"] for r in keep_unrepeated(docs).collect()}
    assert kept[1] == head and set(kept[2]) <= set("xabcé")


def test_leaks(docs, benchmark, none):
    rows = find_leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, 1) for d in (None, 6, 7, 9)}
    kept = drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert _ids(kept) == sorted([None, 1, 2, 3, 4, 5, 8, 10, 10], key=repr)
    assert find_leaks(none, benchmark).collect() == []
    assert find_leaks(docs, benchmark.limit(0)).collect() == []
    assert drop_leaks(docs, benchmark.limit(0)).count() == len(ROWS)


def test_pieces(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.round_trips(docs, path).collect()
    assert len(rows) == len(ROWS) and all(r["same"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert pieces.round_trips(none, path).collect() == []
    back = docs.select("doc_id", pieces.decode(pieces.encode(F.col("text"), path), path).alias("t"))
    assert sorted(r["t"] for r in back.collect()) == sorted((r[1] or "") for r in ROWS)


def test_token_counts(docs, none, out, monkeypatch):
    tokenizer = TokenizerFile(public_tokenizers.path("piece_bpe_32k.model"))
    first = sorted(map(tuple, count_tokens(docs, tokenizer, out + "/cache").collect()), key=repr)
    assert len(first) == len(ROWS)
    texts = {(r[1] or "") for r in ROWS}
    stored = open_cache(docs.sparkSession, out + "/cache", tokenizer.version()).count()
    assert stored == len(texts)
    again = sorted(map(tuple, count_tokens(docs, tokenizer, out + "/cache").collect()), key=repr)
    assert again == first
    assert open_cache(docs.sparkSession, out + "/cache", tokenizer.version()).count() == stored
    assert open_cache(docs.sparkSession, out + "/cache", "other").count() == 0
    assert count_tokens(none, tokenizer, out + "/empty").collect() == []
    bpe = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    special = docs.sparkSession.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    counted = count_tokens(special, bpe, out + "/cache").collect()
    assert counted[0]["n_tokens"] == 3


def test_token_files(docs, none, out):
    from tokenizers import Tokenizer

    tokenizer = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(tokenizer.path)
    rows = token_files(docs, tokenizer, out + "/a").collect()
    counts = [len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS]
    assert sorted(r["n_tokens"] for r in rows) == sorted(counts)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0] + [r["n_tokens"] for r in ordered])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    spaces = ["a  b", " a", "a\n b", "a \n b ", "\t x", "a  b", "é'll we've  ", "<|endoftext|> x", "x <|endoftext|>"]
    more = docs.sparkSession.createDataFrame(list(enumerate(spaces)), "doc_id long, text string")
    for r in token_files(more, tokenizer, out + "/b").collect():
        want = library.encode(spaces[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    assert token_files(none, tokenizer, out + "/c").collect() == []


def test_quality(docs, none):
    rows = classify(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["quality"] <= 1 for r in rows)
    empty = {(r["good_votes"], r["bad_votes"]) for r in rows if r["doc_id"] in (1, 2)}
    assert empty == {(0, 1)}
    assert keep_good(docs).columns == docs.columns
    assert classify(none).collect() == []


def test_quality_sample_of_copies(spark, monkeypatch):
    from tokenloom.llm import quality

    monkeypatch.setattr(quality, "SAMPLE_TEXTS", 16)
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(PROSE), (F.col("id") % 5).cast("string")).alias("text")
    )
    assert quality.sample_share(docs.select("text")) == 1
    assert quality.fit_quality(docs).weights.any()


def _best(rows, k=10, every=100):
    """Brute force over ``(vec_id, vector)``."""
    whole = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole.append((vec_id, [int(np.floor(1024 * float(x))) for x in v]))
    out = []
    for query, q in whole:
        if query % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != query]
        out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(600, 12)).astype(np.float32) * rng.gamma(1, 2, (600, 1)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(25)]  # ties
    rows += [(200, rows[17][1]), (5, rows[5][1]), (5, rows[5][1])]  # repeated ids and rows
    rows += [(None, rows[0][1]), (2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 12)]
    rows += [(2300, [float("inf")] * 12), (2400, []), (2500, [1.0, -2.0]), (-100, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df).collect())
    assert got == _best(rows)
    assert top_k(df.limit(0)).collect() == []
    few = df.filter("vec_id in (100, 101, 102)")
    assert len(top_k(few).collect()) == 2


def test_top_k_blocks(spark, monkeypatch):
    from tokenloom.llm import topk

    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "SEEDS", 7)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(
        (r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, every=20).collect()
    )
    assert got == _best(rows, every=20)


def test_pipeline_stages(docs, none, benchmark, out):
    spark = docs.sparkSession
    benchmark.write.parquet(out + "/benchmark.parquet")
    for table in (docs.select(*SCHEMA.replace(",", "").split()[::2]), none):
        table.write.mode("overwrite").parquet(out + "/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, spark.read.parquet(out + "/documents.parquet"), out)
            if name != "piece_encoding":
                assert got.columns == table.columns and got.count() <= table.count()
        corpus_pipeline.run(spark, out).collect()
