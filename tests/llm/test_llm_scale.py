"""What a worker holds beside the texts at hand."""

import tracemalloc

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from tokenloom.llm import language_id, shingles, substring_dedup, token_files
from tokenloom.llm.batches import text_parts
from tokenloom.llm.language_id import BIGRAMS, TRIGRAMS, distinct_codes, fit
from tokenloom.llm.shingles import set_digest, shingle_sets
from tokenloom.llm.token_counts import TokenizerFile


def codes_of(text: bytes) -> set[int]:
    one = set(text)
    two = {(a << 8 | b) + BIGRAMS for a, b in zip(text, text[1:])}
    three = {(a << 16 | b << 8 | c) + TRIGRAMS for a, b, c in zip(text, text[1:], text[2:])}
    return one | two | three


def test_shingles_are_made_for_a_slice_of_a_batch():
    """Peak of the sets of a batch of 16 MB: some hundred bytes were held for each of 2 MB of text,
    and eight for each word of the batch.
    """
    rng = random.Random(5)
    texts = [None, "", *[" ".join(rng.choices("ab cd efg hi jkl".split(), k=2_000)) for _ in range(2_400)]]
    texts = pa.array([*texts, "long " * 700_000, None], pa.string())
    batch = pa.RecordBatch.from_arrays([texts, pa.array(range(len(texts)))], ["text", "doc_id"])
    parts = list(text_parts(iter([batch, batch.slice(0, 0)])))
    assert [i for part in parts for i in part.column("doc_id").to_pylist()] == list(range(len(texts)))
    assert len(parts) > 5 and max(part.num_rows for part in parts) < 500
    shingles._POWERS.clear()
    whole = [set_digest(tokens) for tokens in shingle_sets(texts.slice(0, 400))]
    shingles._POWERS.clear()
    tracemalloc.start()
    for i, tokens in enumerate(shingle_sets(texts.slice(0, 400))):
        assert set_digest(tokens) == whole[i]
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_parts_of_texts_known_lately_make_no_objects(monkeypatch):
    monkeypatch.setattr(token_files, "_KNOWN", {})
    tokenizer = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    known = token_files.Parts.of(tokenizer)
    given = []

    class Library:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.library.encode_batch_fast(texts, **options)

    known.library = Library(known.library)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcé\u3000.,!1", k=rng.randrange(0, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(40)]
    expected = [
        np.array(one.ids, known.kind).tobytes()
        for one in tokenizer.load().encode_batch_fast(texts, add_special_tokens=False)
    ]
    assert token_files.encode_texts(tokenizer, pa.array(texts)) == expected
    assert isinstance(known.names, pa.StringArray) and len(known.names) > 400
    given.clear()
    assert token_files.encode_texts(tokenizer, pa.array(texts)) == expected and given == []
    # And with parts forgotten before every block.
    monkeypatch.setattr(token_files, "MAX_PARTS", 20)
    for low in range(0, 40, 3):
        part = pa.array(texts).slice(low, 3)
        assert token_files.encode_texts(tokenizer, part) == expected[low : low + 3]
        assert len(known.names) == len(known.used) == len(known.edges) - 1 < 800


def test_codes_and_kernels_need_no_table_over_all_codes(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, n, np.uint8) for n in (1, 2, 3, 400, 401, 1_000, 0)]
    tracemalloc.start()
    found = [distinct_codes(text) for text in texts]
    times = [np.ones(len(codes), np.int32) for codes in found[3:6]]
    model = fit(["a", "b", "a"], found[3:6], times)
    scores = model.scores(texts[3:6])
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    for text, codes in zip(texts, found):
        assert len(codes) == len(set(codes.tolist())) and set(codes.tolist()) == codes_of(text.tobytes())
    assert scores.argmax(axis=1).tolist() == [0, 1, 0]
    # A long text is read piece by piece.
    monkeypatch.setattr(language_id, "PIECE_BYTES", 64)
    assert [set(distinct_codes(t).tolist()) for t in texts] == [set(c.tolist()) for c in found]


class Batches:
    """A table that runs a task's function here, over the given batches."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, emit, schema):  # noqa: N802
        return list(emit(iter(self.batches)))

    def repartition(self, key):
        return self

    sortWithinPartitions = repartition  # noqa: N815


def test_stretches_are_arrays_and_a_repeat_is_one_cut():
    """A copy in a batch was a cut for each of its anchors, and every stretch some objects."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3_000)]
    passage = " ".join(rng.choices(words, k=4_000))
    texts = [passage + " " + " ".join(rng.choices(words, k=300)) for _ in range(40)]
    keys = [np.unique(substring_dedup.stretches(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]) for t in texts]
    anchors = pa.array([(k >> np.uint64(16)).view(np.int64) for k in keys], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(40)), pa.array(range(100, 140)), pa.array(texts), anchors],
        ["text_id", "rank", "text", "anchors"],
    )
    none = np.empty(0, np.uint64)
    tracemalloc.start()
    pieces = pa.Table.from_batches(substring_dedup.text_stretches(Batches([batch]), none))
    assert tracemalloc.get_traced_memory()[1] < 36 << 20
    tracemalloc.stop()
    done = pieces.filter(pieces["stretch"].is_null())
    assert done.num_rows == 39
    assert all(w >= len(passage) - 150 for w in done["windows"].to_pylist())
    rows = pieces.sort_by("key").to_batches(max_chunksize=500)
    cuts = {}
    for part in substring_dedup.repeated_windows(Batches(rows)):
        for text, low, high in zip(*(part.column(i).to_pylist() for i in range(3))):
            cuts.setdefault(text, []).append((low, high))
    seen = {}
    for i, text in enumerate(texts):
        want = [(k, k + 50) for k in range(len(text) - 49) if seen.setdefault(text[k : k + 50], i) < i]
        assert substring_dedup._merged(cuts.get(i, [])) == substring_dedup._merged(want)


def test_cut_documents_need_one_python_step_a_task(spark):
    """The whole characters were a second one, and an executor held twice as many workers."""
    text = "äöü" * 40
    docs = spark.createDataFrame(
        [(1, text, 120), (2, "x" + text[:60] + "z", 62), (3, None, None), (None, "", 0)],
        "doc_id long, text string, n_chars int",
    )
    kept = substring_dedup.keep_unrepeated(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(1, text, 120), (2, "xz", 2), (3, None, None), (None, "", 0)], key=str
    )
    # A cut that ends inside a character takes its other bytes along.
    docs = spark.createDataFrame(
        [(1, "a" * 60 + "ä"), (2, "b" + "a" * 60 + "ö")], "doc_id long, text string"
    )
    assert dict(map(tuple, substring_dedup.keep_unrepeated(docs).collect())) == {
        1: "a" * 60 + "ä", 2: "b"
    }
