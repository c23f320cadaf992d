import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.text import coerce_to_text, is_malformed_utf8, repair_utf8, text_column
from tokenloom.functions.tokenizers import ExternalTokenizer, Utf8ByteTokenizer
from tokenloom.operators.clean import drop_empty, drop_oversize, skip_report, to_documents
from tokenloom.operators.tokenize import tokenize

BAD_BYTES = [
    b"a\xffb",
    b"\xe2\x82",
    b"\xf0\x9f\x98",
    b"\xc0\xaf",
    b"\xed\xa0\x80",
    b"ok",
    b"",
    "é€😀".encode(),
]


def coerced(spark, values, dtype):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", dtype)]))
    return [r[0] for r in df.select(coerce_to_text(F.col("v"), dtype)).collect()]


def test_strings_and_nulls_pass(spark):
    assert coerced(spark, ["a", "", " ", None], T.StringType()) == ["a", "", " ", None]


def test_bytes_are_decoded_with_replacement(spark):
    expected = [b.decode("utf-8", "replace") for b in BAD_BYTES]
    assert coerced(spark, BAD_BYTES, T.BinaryType()) == expected
    df = spark.createDataFrame([(bytearray(b),) for b in BAD_BYTES], "b binary")
    rows = df.select(repair_utf8(F.col("b")), is_malformed_utf8(F.col("b"))).collect()
    assert [r[0] for r in rows] == expected
    assert [r[1] for r in rows] == [True] * 5 + [False] * 3


def test_lists_join_their_non_empty_items(spark):
    strings = T.ArrayType(T.StringType())
    assert coerced(spark, [["a", None, "", "b"], [], [None, ""], None], strings) == [
        "a b",
        None,
        None,
        None,
    ]
    nested = T.ArrayType(strings)
    assert coerced(spark, [[["a", ""], [], ["b", "c"]], [[]]], nested) == ["a b c", None]
    mixed = T.ArrayType(T.BinaryType())
    assert coerced(spark, [[b"x\xff", b"", b"y"]], mixed) == ["x� y"]


def test_other_values_take_their_string_form(spark):
    assert coerced(spark, [1, None], T.LongType()) == ["1", None]
    assert coerced(spark, [True], T.BooleanType()) == ["true"]


def test_missing_column_is_null(spark):
    df = spark.range(2)
    assert [r[0] for r in df.select(text_column(df)).collect()] == [None, None]
    docs = to_documents(df, F.lit("s"), F.col("id"))
    assert docs.columns == ["source", "seq", "text"]


def test_guards_keep_blank_text_and_report_reasons(spark):
    df = spark.createDataFrame(
        [("s", None), ("s", ""), ("s", " "), ("s", "abc"), ("s", "abcdefgh")],
        "source string, text string",
    )
    counted = df.withColumn("n_tokens", Utf8ByteTokenizer().count(F.col("text")))
    kept = drop_oversize(drop_empty(counted), max_tokens=8)
    assert sorted(r["text"] for r in kept.collect()) == [" ", "abc"]
    report = {r["reason"]: r["docs"] for r in skip_report(counted, max_tokens=8).collect()}
    assert report == {"empty": 2, "kept": 2, "oversize": 1}


@pytest.mark.parametrize("separator", [True, False])
def test_byte_tokenizer(spark, separator):
    texts = ["abc", "é€😀", "", None, " ", "x" * 1000]
    tok = Utf8ByteTokenizer(add_separator=separator)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = (
        tokenize(df, tok)
        .select("i", "text", "tokens", tok.count(F.col("text")).alias("n"),
                tok.decode(F.col("tokens")).alias("back"))
        .orderBy("i")
        .collect()
    )
    for row in rows:
        if row["text"] is None:
            assert row["tokens"] is None and row["n"] is None
            continue
        ids = ([256] if separator else []) + list(row["text"].encode())
        assert row["tokens"] == ids
        assert row["n"] == len(ids)
        assert row["back"] == row["text"]


def test_byte_tokenizer_over_sliced_batches(spark):
    """Row order and ids survive batch boundaries inside a partition."""
    df = spark.range(25_000).select("id", F.concat(F.lit("é"), F.col("id")).alias("text"))
    rows = tokenize(df.coalesce(1), Utf8ByteTokenizer()).filter("id % 4999 = 0").collect()
    for row in rows:
        assert row["tokens"] == [256, *row["text"].encode()]


def test_cut_inside_a_character(spark):
    tok = Utf8ByteTokenizer()
    df = spark.createDataFrame([("aé€", k) for k in range(1, 8)], "text string, k long")
    rows = df.select("k", tok.cut(F.col("text"), F.col("k")).alias("t")).orderBy("k").collect()
    raw = "aé€".encode()
    assert [r["t"] for r in rows] == [raw[: k - 1].decode("utf-8", "replace") for k in range(1, 8)]


def pairs_loader():
    """Loader of a byte-level encoder from the tiktoken library, with two merges."""

    def load():
        import tiktoken

        ranks = {bytes([i]): i for i in range(256)} | {b"th": 256, b"the": 257}
        return tiktoken.Encoding(
            "pairs", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={"<end>": 258}
        )

    return load


def test_external_encoder(spark):
    pytest.importorskip("tiktoken")
    tok = ExternalTokenizer("pairs", pairs_loader(), vocab_size=259, separator_id=258)
    texts = ["the cat", "", "é", None, "the the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = (
        tokenize(df.repartition(3), tok)
        .select("i", "tokens", tok.count(F.col("text")).alias("n"),
                tok.decode(F.col("tokens")).alias("back"))
        .orderBy("i")
        .collect()
    )
    direct = pairs_loader()()
    for row, text in zip(rows, texts):
        ids = None if text is None else [258, *direct.encode(text)]
        assert row["tokens"] == ids
        assert row["n"] == (None if ids is None else len(ids))
        assert row["back"] == (text or "")


def picky_loader():
    def load():
        class Picky:
            def encode(self, text):
                if "bad" in text:
                    raise ValueError(text)
                return [len(text)]

            def decode(self, ids):
                raise ValueError(ids)

        return Picky()

    return load


def test_refused_documents_are_counted_not_lost(spark):
    tok = ExternalTokenizer("picky", picky_loader(), vocab_size=100, separator_id=99)
    df = spark.createDataFrame([("s", "good"), ("s", "bad"), ("s", "")], "source string, text string")
    counted = df.withColumn("n_tokens", tok.count(F.col("text")))
    report = {r["reason"]: r["docs"] for r in skip_report(counted).collect()}
    assert report == {"kept": 1, "encode_failed": 1, "empty": 1}
    assert [r[0] for r in df.select(tok.decode(F.array(F.lit(1)))).collect()] == ["", "", ""]
