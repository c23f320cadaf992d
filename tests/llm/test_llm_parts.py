"""Building blocks of the operators against brute force."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm import (
    decontamination,
    jaccard_join,
    pieces,
    quality,
    substring_dedup,
    token_files,
)
from tokenloom.llm.batches import RecentTable
from tokenloom.llm.elias_fano import EliasFano
from tokenloom.llm.graph import components
from tokenloom.llm.language_id import BIGRAMS, TRIGRAMS, distinct_codes
from tokenloom.llm.shingles import shingle_sets
from tokenloom.llm.signature_tree import Group
from tokenloom.llm.suffix_intervals import equal_prefixes
from tokenloom.llm.token_counts import TokenizerFile


@given(st.lists(st.lists(st.integers(1, 3), max_size=20), min_size=1, max_size=8), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_suffix_intervals(strings, length):
    symbols = np.array([s for string in strings for s in [*string, 0]])
    order, new = equal_prefixes(symbols, length)
    group = np.cumsum(new)
    want, place, whole = {}, 0, set()
    for string in strings:
        for i in range(len(string) - length + 1):
            want.setdefault(tuple(string[i : i + length]), set()).add(place + i)
            whole.add(place + i)
        place += len(string) + 1
    got = {}
    for suffix, g in zip(order.tolist(), group.tolist()):
        if suffix in whole:
            got.setdefault(g, set()).add(suffix)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@given(st.lists(st.integers(0, 5_000), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.empty(0, np.int64)
    code = EliasFano.of(values)
    assert code.all().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert code.select(i) == values[i]
    with pytest.raises(IndexError):
        code.select(len(values))
    if len(values) > 300:
        assert len(code.lower) + len(code.upper) < 8 * len(values)


def _components(count, pairs):
    root = list(range(count))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


@pytest.mark.parametrize("seed", range(6))
def test_signature_tree(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, int(n), np.uint64) for n in rng.integers(1, 120, 12)]
    sets = []
    for _ in range(150):
        own = base[rng.integers(len(base))]
        own = own[rng.random(len(own)) > rng.choice([0.02, 0.1, 0.3])]
        extra = rng.integers(0, 1 << 63, int(rng.integers(0, 6)), np.uint64)
        sets.append(np.unique(np.concatenate([own, extra, base[0][:1]])))
    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                pairs.append((i, j))
    links = Group(sets, np.arange(len(sets)), 80).join()
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, pairs)))
    assert _components(len(sets), links) == _components(len(sets), pairs)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    pairs += [(100 + i, 101 + i) for i in range(20)] + [(200, 201 + i) for i in range(30)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = _components(300, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: want[x] for x in linked}


def _sets(texts):
    out = []
    for text in texts:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        if len(words) >= 5:
            out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
        else:
            out.append({tuple(words)} if words else set())
    return out


def test_shingles():
    texts = [None, "", " \n", "One", "one two", "a b c d e", "A B C D E f", "x" * 5000, "é É ü"]
    texts += ["word " * 50, "a b c d", "a b c d e a b c d e a"]
    found = list(shingle_sets(pa.array(texts)))
    want = _sets(texts)
    assert [len(f) for f in found] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


def test_jaccard_brute(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, int(n))) for n in rng.integers(3, 90, 25)]
    texts = []
    for _ in range(260):
        own = list(base[rng.integers(len(base))])
        for _ in range(int(rng.integers(0, 4))):
            own[rng.integers(len(own))] = str(rng.choice(words))
        texts.append(" ".join(own))
    texts += ["", None, "a b", "A  b", *texts[:20]]
    sets = _sets(texts)
    pairs = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    want = _components(len(texts), pairs)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    # Small blocks, so that groups are cut and meet pair by pair.
    for block in (1024, 8):
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
        found = {r["doc_id"]: r for r in jaccard_join.jaccard_components(rows).collect()}
        assert [found[i]["component_id"] for i in range(len(texts))] == want
        assert [found[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def _dedup(rows):
    """(n_bytes, n_removed, n_spans) and the kept bytes of every (doc_id, text)."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            key = data[i : i + 50]
            rank = float("inf") if doc is None else doc
            first[key] = min(first.get(key, float("inf")), rank)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < (float("inf") if doc is None else doc):
                gone[i : i + 50] = 1
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), int(gone.sum()), runs, kept))
    return out


@pytest.mark.parametrize("common", [True, False])
def test_substring_brute(spark, monkeypatch, common):
    import hashlib

    rng = np.random.default_rng(11)
    pool = ["".join(rng.choice(list("abé "), int(n))) for n in rng.integers(5, 120, 14)]
    pool += ["ab" * 60, "x" * 130]
    rows = []
    for i in range(90):
        parts = [pool[k] for k in rng.integers(0, len(pool), int(rng.integers(0, 6)))]
        parts.insert(0, "".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 90)))))
        rows.append((i, "".join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(501, None), (502, ""), (None, rows[4][1])]
    rows += [(7, rows[9][1]), (None, rows[60][1])]
    if common:
        from tokenloom.llm import common_keys

        monkeypatch.setattr(common_keys, "MIN_TEXTS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, substring_dedup.deduplicate(docs).collect()), key=repr)
    want = [
        (doc, n, gone, runs, hashlib.sha256(kept).hexdigest())
        for (doc, _), (n, gone, runs, kept) in zip(rows, _dedup(rows))
    ]
    assert got == sorted(want, key=repr)


def _edits(pattern, text):
    last = np.zeros(len(text) + 1, int)
    for i, p in enumerate(pattern):
        row = np.empty_like(last)
        row[0] = i + 1
        for j, t in enumerate(text):
            row[j + 1] = min(last[j] + (p != t), last[j + 1] + 1, row[j] + 1)
        last = row
    return int(last.min())


@pytest.mark.parametrize("seed", range(4))
def test_leaks_brute(seed):
    rng = np.random.default_rng(seed)

    def prose(n):
        return "".join(rng.choice(list("abcdefg "), n))

    items = [(i, prose(int(n)).strip().encode()) for i, n in enumerate(rng.integers(60, 128, 6))]
    index = decontamination.ItemIndex.build(items)
    texts = []
    for _ in range(30):
        own = list(items[rng.integers(len(items))][1].decode())
        for _ in range(int(rng.integers(0, 16))):
            at = int(rng.integers(len(own)))
            kind = rng.integers(3)
            if kind == 0:
                own[at] = "z"
            elif kind == 1:
                own.insert(at, "y")
            else:
                del own[at]
        texts.append(prose(int(rng.integers(0, 80))) + "".join(own) + prose(int(rng.integers(0, 80))))
    found = {}
    for row, item, start, end, edits in decontamination.search(index, pa.array(texts)):
        found[row, item] = min(edits, found.get((row, item), 99))
        assert 0 <= start < end <= len(texts[row].encode())
    for row, text in enumerate(texts):
        plain = bytes(decontamination.normalise(np.frombuffer(text.encode(), np.uint8))[0])
        for item, data in items:
            part = bytes(decontamination.normalise(np.frombuffer(data, np.uint8))[0]).strip()
            # The whole item, and every segment of it, each within its own budget.
            within = []
            for low, high in {(0, len(part)), *decontamination.segments_of(len(part))}:
                least = _edits(part[low:high], plain)
                if least <= min(int(0.1 * (high - low)), (high - low - 8) // 8):
                    within.append(least)
            assert found.get((row, item)) == min(within, default=None)


@pytest.mark.parametrize("size", [129, 200, 333, 400])
def test_leaks_of_fragments(size):
    rng = np.random.default_rng(size)
    item = "".join(rng.choice(list("abcdefghijklmnop"), size))
    index = decontamination.ItemIndex.build([(1, item.encode()), (2, item[::-1].encode())])
    long = decontamination.FRAGMENT
    assert long == 79
    texts = [
        "".join(rng.choice(list("qrstuvwxyz "), 200)) + item[low : low + long] + " z" * 90
        for low in range(size - long + 1)
    ]
    found = {(row, i) for row, i, *_ in decontamination.search(index, pa.array(texts))}
    assert found == {(row, 1) for row in range(len(texts))}
    # Twelve edits in 128 bytes, wherever they are, as when such a part was one segment.
    for low in sorted({*range(0, size - 127, 64), size - 128}):
        for first in range(0, 116, 5):
            own = list(item[low : low + 128])
            own[first : first + 12] = "z" * 12
            assert list(decontamination.search(index, pa.array(["".join(own)])))


def test_distinct_codes():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 3, 500):
        text = rng.integers(97, 101, size).astype(np.uint8)
        data = bytes(text)
        want = set(data) | {BIGRAMS + (a << 8 | b) for a, b in zip(data, data[1:])}
        want |= {TRIGRAMS + (a << 16 | b << 8 | c) for a, b, c in zip(data, data[1:], data[2:])}
        found = distinct_codes(text).tolist()
        assert len(found) == len(set(found)) and set(found) == want


def test_long_text_codes(monkeypatch):
    from tokenloom.llm import language_id

    text = np.random.default_rng(3).integers(97, 123, 5000).astype(np.uint8)
    want = sorted(distinct_codes(text).tolist())
    monkeypatch.setattr(language_id, "PIECE_BYTES", 700)
    assert sorted(distinct_codes(text).tolist()) == want


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return pieces.PieceModel(file.read())


def test_byte_pair_pieces(model):
    rng = np.random.default_rng(1)
    texts = ["", " ", "  a  b ", "\n\n x\ty", "a▁b", "日本語 ünï 🙂🙂 x", "a" * 400, "<s> </s>"]
    texts += ["".join(rng.choice(list("etaoinshr ▁.,\n01é"), 300)) for _ in range(40)]
    want = model.library.encode(texts)
    got = model.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [model.decode(g).decode() for g in got] == [t.replace("▁", " ") for t in texts]


def test_unigram_search(model, monkeypatch):
    """The same search with summed scores, against all segmentations of short words."""
    monkeypatch.setattr(model, "byte_pair", False)
    words = ["▁the", "▁ther", "▁hested", "▁onward", "▁into", "▁wither"]

    def best(word):
        scores = [(0.0, [])] + [None] * len(word)
        for end in range(1, len(word) + 1):
            options = [
                (scores[a][0] + model.score[word[a:end]], [*scores[a][1], word[a:end]])
                for a in range(end)
                if word[a:end] in model.score
            ]
            scores[end] = max(options)
        return scores[-1]

    for word, parts in model.segment(words):
        assert "".join(parts) == word
        assert sum(model.score[p] for p in parts) == best(word)[0]


ODD = ["a", "the", "'s", "\u00e9", "\u6f22", "\n", "\t", " ", "  ", "\xa0", "\x85", "\x1c", "\u3000", ".", ",,"]
ODD += ["!!?", "1", "23", "\u0120", "<|endoftext|>", "-", "\U0001f642", "\r\n", "\u200b", "\u2009", "x. ", " y,"]


def test_parts_of_token_files(monkeypatch):
    """Ids of odd texts, with tables that turn over all the time, against the library."""
    tokenizer = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_files, "MAX_PARTS", 200)
    monkeypatch.setattr(token_files, "_KNOWN", {})
    rng = np.random.default_rng(7)
    for _ in range(10):
        texts = ["".join(rng.choice(ODD, rng.integers(0, 25))) for _ in range(400)]
        texts += [None, "", " ", "  ", "a ", " a", "word " * 300]
        got = token_files.encode_texts(tokenizer, pa.array(texts, pa.string()))
        given = [t or "" for t in texts]
        want = tokenizer.load().encode_batch_fast(given, add_special_tokens=False)
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [w.ids for w in want]
    assert token_files.encode_texts(tokenizer, pa.array([], pa.string())) == []


def test_recent_table():
    table = RecentTable(8)
    for block in (["a", "b"], ["c", "a"], ["d", "e", "a"], ["f", "a", "a"], ["b", "g", "a"]):
        fresh = table.missing(block)
        assert set(fresh) <= set(block) and len(fresh) == len(set(fresh))
        assert "a" not in fresh or block == ["a", "b"]  # used in every block, so never forgotten
        table.learn(fresh, [k * 2 for k in fresh])
        assert table.values(block) == [k * 2 for k in block]
        assert len(table.young) + len(table.old) <= 8 + len(block)
    assert table.missing([]) == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.85
    voted = np.full((len(good), 6), quality.NONE)
    for j in range(6):
        right = rng.random(len(good)) < np.where(good, 0.97, 0.6)
        speaks = rng.random(len(good)) < 0.7
        voted[speaks, j] = np.where(right == good, quality.GOOD, quality.BAD)[speaks]
    patterns, counts = np.unique(voted, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model.share - 0.85) < 0.05
    assert np.mean((model.posterior(voted) > 0.5) == good) > 0.93
