"""Line-numbered scans, zone maps, broken bytes."""

import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from models import take_budget
from tokenloom.functions.tokenizers import Utf8ByteTokenizer
from tokenloom.operators.budget import mixture
from tokenloom.operators.clean import skip_report, to_documents
from tokenloom.plans.prepare import prepare, prepare_corpora
from tokenloom.sources.corpus import ROW_BITS, corpus_files, scan_corpus
from tokenloom.sources.zones import count_until_met, needed_zones, next_files
from pyspark.sql import functions as F


@pytest.fixture()
def splits(spark):
    """Sets the size of the splits that files are cut into."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        for name, value in zip(names, (size, "1")):
            spark.conf.set(name, value)

    yield cut
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_json_lines_have_the_same_numbers_under_any_split(spark, out, splits):
    rng = random.Random(1)
    want = []
    os.makedirs(f"{out}/in")
    for number, name in enumerate(("a b%", "b", "c")):
        with open(f"{out}/in/{name}.jsonl", "w") as file:
            for row in range(300):
                if row % 50 == 7:
                    file.write("\n")
                    continue
                text = rng.choice([None, "x" * rng.randrange(200), 'é\n"q"', 5, True, ["p", "q"]])
                told = {5: "5", True: "true"}.get(text) if isinstance(text, (int, bool)) else text
                told = '["p","q"]' if isinstance(text, list) else told
                file.write(json.dumps({"z": 1, **({"text": text} if row % 3 else {})}) + "\n")
                want.append(((number << ROW_BITS) | row, told if row % 3 else None))
    for size in ("128m", "3k", "700"):
        splits(size)
        docs = scan_corpus(spark, {"s": f"{out}/in"}, file_format="json")
        assert docs.columns == ["source", "seq", "text"]
        assert sorted((r["seq"], r["text"]) for r in docs.collect()) == want
        lines = scan_corpus(spark, {"s": f"{out}/in"}, file_format="text")
        numbers = sorted(r["seq"] for r in lines.collect())
        assert numbers == [(f << ROW_BITS) | r for f in range(3) for r in range(300)]
    assert lines._jdf.queryExecution().toString().count("CartesianProduct") == 0
    files = corpus_files(spark, f"{out}/in", "json")
    assert [os.path.basename(f) for f in files] == ["a b%.jsonl", "b.jsonl", "c.jsonl"]
    # A part of the files has the numbers of the whole.
    part = scan_corpus(spark, {"s": files[:2]}, file_format="json").collect()
    assert sorted((r["seq"], r["text"]) for r in part) == [w for w in want if w[0] >> ROW_BITS < 2]


def test_json_of_lists_and_broken_lines(spark, out):
    with open(f"{out}/x.jsonl", "wb") as file:
        file.write(b'{"t": ["a", "", null, "b"]}\n{"t": []}\n{"t": ["\xff"]}\n')
    docs = scan_corpus(spark, {"s": f"{out}/x.jsonl"}, "t", "json", "array<string>")
    assert [r["text"] for r in docs.orderBy("seq").collect()] == ["a b", None, "�"]
    with open(f"{out}/y.jsonl", "w") as file:
        file.write('{"text": "a"}\n{"text": \n{"text": "c"}\n')
    broken = {"s": f"{out}/y.jsonl"}
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_corpus(spark, broken, file_format="json").collect()
    kept = scan_corpus(spark, broken, file_format="json", json_mode="PERMISSIVE")
    assert [r["text"] for r in kept.orderBy("seq").collect()] == ["a", None, "c"]
    with pytest.raises(ValueError, match="file_format"):
        scan_corpus(spark, broken, file_format="csv")


def test_next_files():
    assert next_files(0, 5, 0, 10) == 1
    assert next_files(1, 4, 3, 10) == 1  # no more than were opened
    assert next_files(4, 9, 40, 51) == 2
    assert next_files(4, 9, 40, 40) == 0 and next_files(4, 0, 4, 40) == 0
    assert next_files(3, 9, 0, 40) == 3


def corpus(out):
    """Nine files of source A, two of B; the texts of each."""
    rng = random.Random(4)
    texts = {"A": [], "B": []}
    for source, files in (("A", 9), ("B", 2)):
        os.makedirs(f"{out}/{source}")
        for number in range(files):
            own = ["" if rng.random() < 0.2 else "né" * rng.randrange(1, 20) for _ in range(10)]
            pq.write_table(pa.table({"text": own}), f"{out}/{source}/f{number}.parquet")
            texts[source] += [((number << ROW_BITS) | row, t) for row, t in enumerate(own)]
    return {s: f"{out}/{s}" for s in texts}, texts


@pytest.mark.parametrize("target", [1, 400, 1_500, 10**6])
def test_only_needed_files_are_opened(spark, out, target):
    paths, texts = corpus(out)
    targets = {"A": target, "B": 10**6, "C": 5}
    spec = mixture(spark, targets)
    counted = count_until_met(spark, paths, spec, Utf8ByteTokenizer())
    tokens = [
        sum(len(t.encode()) + 1 for q, t in texts["A"] if t and q >> ROW_BITS == f) for f in range(9)
    ]
    needed = next((f + 1 for f in range(9) if sum(tokens[: f + 1]) >= target), 9)
    assert [os.path.basename(f) for f in counted.files["A"]] == [f"f{i}.parquet" for i in range(needed)]
    assert len(counted.files["B"]) == 2
    zones = {(r["source"], r["number"]): r for r in counted.zones.collect()}
    opened = sum(s == "A" for s, _ in zones)
    assert opened < 2 * needed + 1
    for f in range(needed):
        assert zones["A", f]["tokens"] == tokens[f] and zones["A", f]["docs"] == 10
        assert zones["A", f]["low_seq"] == f << ROW_BITS
    ended = {r["source"]: r["ended"] for r in counted.ended.collect()}
    assert ended == {"A": opened == 9, "B": True, "C": True}
    kept = needed_zones(counted.zones, spec).filter("source = 'A'").collect()
    assert sorted(r["number"] for r in kept) == list(range(needed))

    # The plan of the second scan lists the needed files alone.
    docs = scan_corpus(spark, {s: f for s, f in counted.files.items() if f})
    assert len(docs.inputFiles()) == needed + 2


def test_the_job_over_needed_files_is_the_full_one(spark, out):
    paths, texts = corpus(out)
    target = 700
    spec = mixture(spark, {"A": target, "B": 10**6, "C": 5})
    done = prepare_corpora(spark, paths, spec, Utf8ByteTokenizer(), f"{out}/p", raw_limit=300,
                           token_limit=200, val_cap=50)
    full = prepare(scan_corpus(spark, paths), spec, Utf8ByteTokenizer(), f"{out}/f", raw_limit=300,
                   token_limit=200, val_cap=50)
    columns = ["source", "target_tokens", "written_tokens", "shortfall", "ran_out"]
    assert sorted(done.report.select(columns).collect()) == sorted(full.report.select(columns).collect())
    read = {r["source"]: r["available_tokens"] for r in done.report.collect()}
    assert read["A"] is None and read["C"] == 0
    assert read["B"] == sum(len(t.encode()) + 1 for _, t in texts["B"] if t)
    assert sorted(done.skipped.collect()) == sorted(full.skipped.collect())
    for a, b in ((done.raw_path, full.raw_path), (done.token_path, full.token_path)):
        one, two = (spark.read.parquet(p) for p in (a, b))
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    taken = take_budget([d for d in texts["A"] if d[1]], target)
    assert done.report.filter("source = 'A'").first()["written_tokens"] == sum(n for _, n, _ in taken)


def test_nothing_to_open(spark, out):
    paths, _ = corpus(out)
    spec = mixture(spark, {"A": 0, "Z": 4})
    counted = count_until_met(spark, paths, spec, Utf8ByteTokenizer())
    assert counted.files == {"A": []} and counted.counts.count() == 0
    with pytest.raises(ValueError, match="no documents"):
        prepare_corpora(spark, paths, spec, Utf8ByteTokenizer(), f"{out}/p")


def test_broken_text_is_repaired_and_counted(spark):
    df = spark.createDataFrame([(1, "fine"), (2, None), (3, "")], "i long, text string")
    df = df.unionByName(spark.sql("select 4L i, cast(unhex('61FF62') as string) text"))
    docs = to_documents(df, F.lit("s"), F.col("i"), flag=True)
    rows = {r["seq"]: (r["text"], r["malformed"]) for r in docs.collect()}
    assert rows == {1: ("fine", False), 2: (None, False), 3: ("", False), 4: ("a�b", True)}
    counted = docs.withColumn("n_tokens", F.octet_length("text") + 1)
    assert {(r["reason"], r["docs"]) for r in skip_report(counted).collect()} == {
        ("kept", 1), ("empty", 2), ("malformed", 1)}
    nested = spark.sql("select array(array(unhex('FF'), unhex('61'))) text, 1L i")
    assert to_documents(nested, F.lit("s"), F.col("i"), flag=True).first()["malformed"]
