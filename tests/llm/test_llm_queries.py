"""Registered queries against their SQL, and the rest against brute force, on the smallest tables."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from tokenloom.llm.oracle import ORACLE_SQL
from tokenloom.llm.queries import QUERIES
from tokenloom.llm.token_counts import TokenizerFile
from tokenloom.llm.token_files import find_offsets, token_files


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_leaks(spark, duck, texts):
    found = QUERIES["op2_decontamination"](spark, SF).collect()
    items = dict(duck.sql("select item_id, text from benchmark").fetchall())
    whole = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t}
    assert whole and whole == {(r["doc_id"], r["item_id"]) for r in found}
    for r in found:
        part = texts[r["doc_id"]].encode()[r["span_start"] : r["span_end"]].decode()
        assert r["edits"] == 0 and part.strip() == items[r["item_id"]].strip()


def test_languages(spark, duck):
    rows = QUERIES["op3_language_id"](spark, SF).collect()
    lang = dict(duck.sql("select doc_id, lang from documents").fetchall())
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op7_token_files"](spark, SF).collect()}
    start = 0
    for doc in sorted(texts):
        ids = library.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        digest = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(rows[doc]) == (doc, start, len(ids), digest)
        start += len(ids)


def test_found_offsets(spark, out):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tokenizer = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    all_rows = token_files(docs, tokenizer, out + "/files").select("doc_id", "start", "n_tokens")
    want = {tuple(r) for r in all_rows.collect() if r["doc_id"] % 7 == 0}
    ids = [(r[0],) for r in want] * 2 + [(None,), (-1,)]
    wanted = spark.createDataFrame(ids, "doc_id long").withColumn("start", F.lit("x"))
    found = [tuple(r) for r in find_offsets(wanted, out + "/files").collect()]
    assert len(found) == len(want) and set(found) == want
    assert find_offsets(wanted.limit(0), out + "/files").collect() == []


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces(spark, texts, model):
    rows = QUERIES["op8_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(model.encode(texts[r["doc_id"]]), "<i4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
        assert r["same"] and r["decoded_bytes"] == r["n_bytes"]


def test_token_counts(spark, texts, model):
    for r in QUERIES["op9_token_counts"](spark, SF).collect():
        text = texts[r["doc_id"]]
        count = len(model.encode(text))
        assert tuple(r) == (r["doc_id"], len(text.encode()), count, count > 4096)


def test_quality(spark, duck):
    rows = {r["doc_id"]: r for r in QUERIES["op10_quality"](spark, SF).collect()}
    labels = duck.sql("select doc_id, quality from labels").fetchall()
    kept = [rows[d]["is_good"] for d, q in labels if q == 1]
    dropped = [not rows[d]["is_good"] for d, q in labels if q == 0]
    assert np.mean(kept) >= 0.98 and np.mean(dropped) >= 0.5


def test_pipeline(spark, duck, texts, model):
    """The stages one after the other in plain Python, on the registered queries' results."""
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    kept = dict(texts)
    group = {
        r["doc_id"]: r["component_id"] for r in QUERIES["op4_jaccard_join"](spark, SF).collect()
    }
    kept = {d: t for d, t in kept.items() if group[d] == d}
    seen, cut = set(), {}
    for doc in sorted(kept):
        data = kept[doc].encode()
        gone = np.zeros(len(data), bool)
        own = {data[i : i + 50] for i in range(len(data) - 49)}
        for i in range(len(data) - 49):
            if data[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= own
        cut[doc] = bytes(np.frombuffer(data, np.uint8)[~gone]).decode("utf-8", "ignore")
    items = [r[0] for r in duck.sql("select text from benchmark").fetchall()]
    want = {d: t for d, t in cut.items() if not any(i in t for i in items)}
    assert set(rows) == set(want)
    assert all(rows[d]["ids"] == model.encode(t) for d, t in want.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "jaccard_join",
        "substring_dedup",
        "decontamination",
        "piece_encoding",
    ]
