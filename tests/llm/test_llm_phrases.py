"""Word windows, phrases and Merkle manifests against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.llm import merkle, word_dedup
from tokenloom.llm.collocations import collocations
from tokenloom.llm.double_array import DoubleArray, NumberTable
from tokenloom.llm.fm_index import FMIndex, WaveletMatrix, least_within
from tokenloom.llm.words import SPACES, byte_table, hash_words, split_words

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


# Parts ------------------------------------------------------------------------------------------


@given(st.lists(st.binary(max_size=40), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, edges = split_words(data, offsets, byte_table(SPACES))
    raw = data.tobytes()
    got = [[raw[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(edges, edges[1:])]
    assert got == [WORD.findall(t) for t in texts]
    hashes = hash_words(data, starts, ends)
    by_word = defaultdict(set)
    for word, h in zip([w for row in got for w in row], hashes.tolist()):
        by_word[word].add(h)
    assert all(len(h) == 1 for h in by_word.values())
    assert len({h for own in by_word.values() for h in own}) == len(by_word)


def test_long_words_differ_in_any_byte():
    words = [b"a" * n for n in (8, 9, 255, 256, 257, 300)] + [b"a" * 299 + b"b", b"b" + b"a" * 299]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = split_words(data, np.array([0, len(data)]), byte_table(SPACES))
    assert len(set(hash_words(data, starts, ends).tolist())) == len(words)


@given(st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=14), min_size=1, max_size=9),
       st.integers(1, 6))
@settings(max_examples=120, deadline=None)
def test_fm_index(strings, depth):
    text = np.array([s for string in strings for s in [*string, 0]])
    tree = WaveletMatrix(text, 7)
    for symbol in range(7):
        at = np.arange(len(text) + 1)
        want = [int((text[:i] == symbol).sum()) for i in at]
        assert tree.rank(np.full(len(at), symbol), at).tolist() == want
    places = np.array([i for i in range(len(text) - depth + 1) if (text[i : i + depth] > 0).all()], int)
    index = FMIndex(text, 7, depth)
    for least in (1, 2):
        which, low, high = index.intervals(places, least)
        got = {int(places[w]): sorted(index.order[a:b].tolist()) for w, a, b in zip(which, low, high)}
        want = {}
        for p in places.tolist():
            same = [q for q in places.tolist() if (text[q : q + depth] == text[p : p + depth]).all()]
            if len(same) >= least:
                want[p] = same
        assert got == want
        if len(low):
            values = np.arange(len(text))[::-1]
            assert least_within(values, low, high).tolist() == [values[a:b].min() for a, b in zip(low, high)]


@pytest.mark.parametrize("rows,alphabet", [(1, 2), (60, 5), (4_000, 50), (9_000, 3_000)])
def test_double_array(rows, alphabet):
    rng = np.random.default_rng(rows)
    paths = {tuple(rng.integers(1, alphabet, rng.integers(1, 5)).tolist()) for _ in range(rows)}
    paths = sorted({p[:j] for p in paths for j in range(1, len(p) + 1)})
    table = np.zeros((len(paths), 4), np.int64)
    for i, path in enumerate(paths):
        table[i, : len(path)] = path
    trie, known = DoubleArray(table, alphabet), {p: i for i, p in enumerate(paths)}
    asked = np.concatenate([table[:500], rng.integers(0, alphabet, (500, 4))])
    state = np.zeros(len(asked), np.int64)
    for level in range(4):
        state = trie.step(state, asked[:, level])
        want = [known.get(tuple(row[: level + 1].tolist()), -1) for row in asked]
        assert trie.ends[state].tolist() == want


def test_number_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5_000).astype(np.uint64))
    table = NumberTable(keys)
    assert table.find(keys).tolist() == list(range(1, len(keys) + 1))
    assert not table.find(keys + np.uint64(1)).any()
    assert NumberTable(keys[:0]).find(keys[:3]).tolist() == [0, 0, 0]


# Word windows ---------------------------------------------------------------------------------


def _cut(rows):
    first = {}
    docs = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    for d, w in docs:
        for i in range(len(w) - 12 if d is not None else 0):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 12 if d is not None else 0):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(1)
    words = ["a", "b", "c", "dd", "e" * 9, "f" * 300, "é", "g" * 17]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(5)]
    rows = []
    for i in range(200):
        text = rng.choice(base).split()[rng.randrange(150) :][: rng.randrange(5, 80)]
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = f"zz{i}"
        rows.append((rng.choice([i, i, i, None, 7]), rng.choice(["  ", "\n", "\t\x0b"]).join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "x " * 50), (1004, "x " * 49)]
    rows += [(1005, base[0] * 2), (1006, base[0]), (1006, base[0]), (None, base[0])]
    return rows


@pytest.mark.parametrize("crowded", [word_dedup.CROWDED, 0, 3])
def test_word_windows(spark, crowded):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string").repartition(5)
    docs = docs.withColumn("kept", F.lit(0)).withColumn("rank", F.lit("r"))
    rows = word_dedup.cut_words(docs, crowded).collect()
    got = [
        (r["c0"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"] or b"").hexdigest())
        for r in rows
    ]
    assert sorted(got, key=repr) == _cut(_rows())
    for r in rows:
        assert sum(s["high"] - s["low"] for s in r["spans"]) == r["n_removed"]
        assert (r["c1"], r["c2"]) == (0, "r") or (r["c2"], r["c1"]) == ("r", 0)


def test_shards_do_not_matter(spark):
    """Shards of a few hundred words, and one anchor of many different stretches, give the same."""
    header = " ".join(f"h{i}" for i in range(20))
    rows = _rows() + [(2000 + i, f"{header} v{i} " + " ".join(f"w{i}x{j}" for j in range(13))) for i in range(400)]
    docs = spark.createDataFrame(rows, "rank long, text string").filter("rank is not null")
    texts = docs.select("rank", *word_dedup._text_ids(), "text")
    none = np.empty(0, np.uint64)
    shared = word_dedup.shared_anchors(texts.select("ta", "tb", "text"), none)
    ranks = texts.groupBy("ta", "tb").agg(F.min("rank").alias("rank"))
    found = texts.join(ranks, ["ta", "tb", "rank"]).join(shared, ["ta", "tb"], "left")
    units = word_dedup.text_units(found.select("ta", "tb", "rank", "text", "anchors"), none)

    def covered(cuts):
        return {(r["ta"], r["tb"], i) for r in cuts.collect() for i in range(r["low"], r["high"])}

    want = covered(word_dedup.repeated_words(units))
    assert len(want) > 400 * 20
    assert covered(word_dedup.repeated_words(units, shard_words=300, waiting_rows=20)) == want


def test_word_windows_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert word_dedup.deduplicate_words(none).collect() == []


# Phrases ----------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _phrases(rows, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= 30}
        most = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        ranked = []
        for p, a in found.items():
            if 100 * most[p] < 80 * a:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("limit,top", [(1 << 20, 2000), (7, 2000), (40, 5)])
def test_collocations(spark, limit, top):
    rng = random.Random(2)
    words = ["Aa", "b", "é", "c.d", "x\x0by", "New", "York", "City", "in"]
    rows = [
        (rng.choice(["en", None, "und", ""]),
         rng.choice([" ", "\t", ", ", "  "]).join(rng.choice(words) for _ in range(30)) + " new york city in")
        for _ in range(150)
    ]
    rows += [(None, None), ("en", ""), ("fr", " . ")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    docs = docs.withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2))
    assert sorted(map(tuple, collocations(docs, top, limit).collect())) == _phrases(rows, top)


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).collect() == []


# Manifests --------------------------------------------------------------------------------------


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def _sides(levels, place, fanout):
    out = []
    for nodes in levels[:-1]:
        low = place // fanout * fanout
        out.append(("".join(nodes[low:place]), "".join(nodes[place + 1 : low + fanout])))
        place //= fanout
    return out


def _manifest(rows, fanout=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[lang] = _levels([_leaf(r) for r in groups[lang]], fanout)
    top = _levels([trees[lang][-1][0] for lang in langs], fanout)
    out = []
    for number, lang in enumerate(langs):
        for place, row in enumerate(groups[lang]):
            path = _sides(trees[lang], place, fanout) + _sides(top, number, fanout)
            node = _leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = _leaf((*row[:3], row[3] + 1, row[4]))
            for left, right in path:
                node = _hash(left + node + right)
            proof = _hash("".join(left + right for left, right in path))
            out.append((row[0], _leaf(row), trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_of_odd_rows(spark):
    rows = [(1, "a", None, 3, "x"), (None, "a", None, None, None), (5, None, "en", 2, "")] * 2
    rows += [(2, "b", "de", 1, "é"), (2, "b", "de", 1, "ü"), (7, "b", "", 1, "l" * 100_000)]
    docs = spark.createDataFrame(rows, DOCUMENT).withColumn("digest", F.lit(0))
    got = sorted(map(tuple, merkle.verify_documents(docs).collect()), key=repr)
    assert got == _manifest(rows)
    assert merkle.verify_documents(spark.createDataFrame([], DOCUMENT)).collect() == []


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_over_several_buckets(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    langs = ["en", "de", None, "x"]
    rows = [(i, "s", langs[0 if i % 3 else i % 4], i, str(i)) for i in range(150)]
    rows += [(i, "s", f"l{i}", i, str(i)) for i in range(150, 170)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    leaves = docs.select(
        merkle.group_key(F.col("lang")).alias("grp"),
        "doc_id",
        merkle.leaf_digest([F.col(c) for c in merkle.LEAF_COLUMNS]).alias("digest"),
    )
    made = merkle.manifest(leaves, fanout)
    proofs = made.proofs().withColumn("folded", merkle.fold(F.col("leaf"), F.col("path")))
    proofs = proofs.withColumn("proof", merkle.path_digest(F.col("path"))).collect()
    want = {r[0]: r for r in _manifest(rows, fanout)}
    assert len(proofs) == len(rows)
    for r in proofs:
        assert (r["leaf"], r["top"], r["root"], r["proof"]) == want[r["doc_id"]][1:5]
        assert r["folded"] == r["root"] == made.root()
    nodes = defaultdict(dict)
    for r in made.nodes().collect():
        assert r["low"] % fanout ** r["level"] == 0 and r["low"] < r["high"]
        assert (r["level"], r["low"]) not in nodes[r["grp"]]
        nodes[r["grp"]][r["level"], r["low"]] = r
    for own in nodes.values():
        for (level, low), r in own.items():
            if level:
                inner = [n for n in own.values() if n["level"] == level - 1 and low <= n["low"] < r["high"]]
                assert r["digest"] == _hash("".join(n["digest"] for n in sorted(inner, key=lambda n: n["low"])))
                assert max(n["high"] for n in inner) == r["high"]
