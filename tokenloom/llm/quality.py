"""Quality classification from weak labels.

Thirteen heuristics look at a whole text and vote good, bad or nothing. Expectation-maximisation over
the counts of all documents' vote patterns estimates how often each heuristic votes which way on good
and on bad texts, without any given label. The posterior of a bounded sample's patterns is the
target of a linear scorer over hashed byte 4-grams and hashed statistics, which then scores every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.batches import binary_rows, blocks, text_bytes
from tokenloom.llm.shingles import word_hashes
from tokenloom.session import ship_package

BAD, GOOD, NONE = 0, 1, 2
# (name, bad below, good from, good up to, bad above): between the two sides there is no vote.
HEURISTICS: list[tuple[str, float, float, float, float]] = [
    ("words", 5, 20, np.inf, np.inf),
    ("word_bytes", 2.0, 3.0, 11.0, 16.0),
    ("symbol_share", -1, -1, 0.01, 0.05),
    ("upper_share", -1, -1, 0.15, 0.40),
    ("shout_share", -1, -1, 0.005, 0.03),
    ("digit_share", -1, -1, 0.05, 0.20),
    ("bar_share", -1, -1, 0.002, 0.03),
    ("distinct_share", 0.12, 0.25, np.inf, np.inf),
    ("top_word_share", -1, -1, 0.12, 0.20),
    ("repeated_line_share", -1, -1, 0.10, 0.30),
    ("letter_share", 0.75, 0.85, np.inf, np.inf),
    ("odd_end_share", -1, -1, 0.05, 0.25),
    ("same_next_share", -1, -1, 0.02, 0.10),
]
# Size of the hashed feature table, documents of the sample (about), and bins of a statistic.
BUCKETS, SAMPLE_TEXTS, BINS = 2048, 4096, 8
GRAM_WEIGHT = 30.0
RIDGE, STEPS = 1e-3, 400
EM_ROUNDS = 200
# Times a heuristic's bad vote is at least as frequent on bad texts as on good ones.
BETTER = 5.0


def _classes() -> np.ndarray:
    """Bits of each byte: symbol, upper-case letter, exclamation mark, digit, bar, ASCII letter,
    byte of any letter.
    """
    table = np.zeros(256, np.uint8)
    for byte in b"#$%&*@^~<>{}[]\\=+_":
        table[byte] |= 1
    table[65:91] |= 2 | 32
    table[97:123] |= 32
    table[(table & 32) > 0] |= 64
    table[128:] |= 64
    table[ord("!")] |= 4
    table[48:58] |= 8
    table[ord("|")] |= 16
    return table


CLASSES = _classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistic of every heuristic for each text of a block; nan where it has none."""
    rows = len(offsets) - 1
    out = np.full((rows, len(HEURISTICS)), np.nan)
    kinds = CLASSES[data]

    def count(bit: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum((kinds & bit) > 0, dtype=np.int32)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.diff(offsets).astype(float)
    words, edges = word_hashes(data, offsets)
    number = np.diff(edges).astype(float)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    spaces = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
    ends = np.ones(len(data), bool)
    ends[:-1] = gap[1:]
    ends[offsets[1:][size > 0] - 1] = True
    odd = np.concatenate([[0], np.cumsum(ends & ((kinds & 17) > 0), dtype=np.int32)])
    odd = odd[offsets[1:]] - odd[offsets[:-1]]
    twin = np.concatenate([[0], [0], np.cumsum(words[1:] == words[:-1])])[: len(words) + 1]
    inked = size - (spaces[offsets[1:]] - spaces[offsets[:-1]])
    with np.errstate(invalid="ignore", divide="ignore"):
        out[:, 0] = number
        out[:, 1] = np.where(number > 0, inked / number, np.nan)
        for column, bit in ((2, 1), (4, 4), (5, 8), (6, 16)):
            out[:, column] = np.where(inked > 0, count(bit) / inked, np.nan)
        letters = count(32)
        out[:, 3] = np.where(letters > 0, count(2) / letters, np.nan)
        plain = inked - count(8)  # digits are neither
        out[:, 10] = np.where(plain > 0, count(64) / plain, np.nan)
        out[:, 11] = np.where(number > 0, odd / number, np.nan)
        first = np.minimum(edges[:-1] + 1, edges[1:])
        same = twin[edges[1:]] - twin[first]
        out[:, 12] = np.where(number > 1, same / np.maximum(1, number - 1), np.nan)
    for i in range(rows):
        own = words[edges[i] : edges[i + 1]]
        if len(own) >= 20:
            # Shares of windows of 2000 words, so that a long text is not poor in words for its
            # length; the worst and the most repetitive window count.
            parts = [own[a : a + 2000] for a in range(0, max(1, len(own) - 19), 2000)]
            shares, tops = [], []
            for part in parts:
                counts = np.unique(part, return_counts=True)[1]
                shares.append(len(counts) / len(part))
                tops.append(counts.max() / len(part))
            out[i, 7], out[i, 8] = np.mean(shares), np.mean(tops)
        lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        lines = [line for line in lines if line]
        if len(lines) > 1:
            out[i, 9] = 1 - len(set(lines)) / len(lines)
    return out


def votes(values: np.ndarray) -> np.ndarray:
    """Each heuristic's vote on each text."""
    out = np.full(values.shape, NONE)
    for j, (_, bad_low, good_low, good_high, bad_high) in enumerate(HEURISTICS):
        value = values[:, j]
        out[(value >= good_low) & (value <= good_high), j] = GOOD
        out[(value < bad_low) | (value > bad_high), j] = BAD
    return out


def pattern(voted: np.ndarray) -> np.ndarray:
    """One number for the votes of a text, base three."""
    return (voted * 3 ** np.arange(voted.shape[1])).sum(axis=1)


@dataclass
class LabelModel:
    """``share`` of good texts, and ``rates[label, heuristic, vote]`` among the texts on which the
    heuristic votes. No vote says nothing about a text.
    """

    share: float
    rates: np.ndarray

    def posterior(self, voted: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        good = np.log(self.share)
        bad = np.log(1 - self.share)
        for j in range(voted.shape[1]):
            good = good + np.log(self.rates[GOOD, j, voted[:, j]])
            bad = bad + np.log(self.rates[BAD, j, voted[:, j]])
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def estimate(voted: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts. It starts from heuristics
    whose bad votes are ten times as frequent on bad texts, which also tells the two labels apart.
    """
    heuristics = voted.shape[1]
    rates = np.empty((2, heuristics, 3))
    rates[BAD] = np.array([0.3, 0.7, 1.0])
    rates[GOOD] = np.array([0.03, 0.97, 1.0])
    model = LabelModel(0.8, rates)
    total = counts.sum()
    if not total:
        return model
    for _ in range(EM_ROUNDS):
        good = model.posterior(voted)
        share = float(np.clip((good * counts).sum() / total, 1e-3, 1 - 1e-3))
        fresh = np.empty_like(rates)
        for label, weight in ((GOOD, good * counts), (BAD, (1 - good) * counts)):
            for j in range(heuristics):
                sums = np.bincount(voted[:, j], weights=weight, minlength=3)[:NONE] + 0.5
                fresh[label, j] = [*sums / sums.sum(), 1.0]
        # A labeller is better than chance: its bad votes are rarer on good texts by a factor.
        rare = np.minimum(fresh[GOOD, :, BAD], fresh[BAD, :, BAD] / BETTER)
        fresh[GOOD, :, BAD], fresh[GOOD, :, GOOD] = rare, 1 - rare
        moved = abs(share - model.share) + float(np.abs(fresh - model.rates).max())
        model = LabelModel(share, fresh)
        if moved < 1e-9:
            break
    return model


def _gram_slots(data: np.ndarray) -> np.ndarray:
    if len(data) < 4:
        return np.empty(0, np.int64)
    data = np.ascontiguousarray(data)
    codes = np.ndarray((len(data) - 3,), np.uint32, buffer=data.data, strides=(1,))
    return ((codes * np.uint32(2_654_435_761)) >> np.uint32(32 - 11)).astype(np.int64)


def _bin_slots(values: np.ndarray) -> np.ndarray:
    """Buckets of the binned statistics, one per heuristic and text."""
    slots = np.empty(values.shape, np.int64)
    for j, (_, bad_low, good_low, good_high, bad_high) in enumerate(HEURISTICS):
        edges = [e for e in (bad_low, good_low, good_high, bad_high) if 0 <= e < np.inf]
        place = np.searchsorted(np.sort(edges), values[:, j])
        place = np.where(np.isnan(values[:, j]), BINS - 1, place)
        slots[:, j] = ((j * BINS + place + 1) * 2_654_435_761 % (1 << 32)) >> (32 - 11)
    return slots


def features(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashed feature rows of a block of texts: shares of byte 4-grams, and binned statistics."""
    slots = _gram_slots(data)
    bins = _bin_slots(values)
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    for i in range(len(out)):
        own = slots[offsets[i] : max(offsets[i], offsets[i + 1] - 3)]
        if len(own):
            out[i] = np.bincount(own, minlength=BUCKETS) * (GRAM_WEIGHT / len(own))
        np.add.at(out[i], bins[i], 1)
    return out


@dataclass
class QualityModel:
    """The label model and the scorer's weights, with a constant at the end."""

    labels: LabelModel
    weights: np.ndarray

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quality, and the votes and posterior behind it, of every text of a batch."""
        offsets, data = text_bytes(texts)
        quality, voted, behind = [], [], []
        for low, high in blocks(offsets):
            part = offsets[low : high + 1] - offsets[low]
            own = data[offsets[low] : offsets[high]]
            values = statistics(own, part)
            gram = np.concatenate([[0.0], np.cumsum(self.weights[_gram_slots(own)])])
            last = np.maximum(part[:-1], part[1:] - 3)
            last, first = np.minimum(last, len(gram) - 1), np.minimum(part[:-1], len(gram) - 1)
            number = np.maximum(1, last - first)
            margin = (gram[last] - gram[first]) * GRAM_WEIGHT / number
            margin += self.weights[_bin_slots(values)].sum(axis=1) + self.weights[-1]
            quality.append(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
            voted.append(votes(values))
            behind.append(self.labels.posterior(voted[-1]))
        empty = np.empty(0)
        return (
            np.concatenate([empty, *quality]),
            np.concatenate([np.empty((0, len(HEURISTICS)), int), *voted]),
            np.concatenate([empty, *behind]),
        )


def vote_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all documents and their counts; there are at most 3^13 of them."""

    @F.arrow_udf("long")
    def voted(texts: pa.Array) -> pa.Array:
        offsets, data = text_bytes(texts)
        out = [np.empty(0, np.int64)]
        for low, high in blocks(offsets):
            part = offsets[low : high + 1] - offsets[low]
            out.append(pattern(votes(statistics(data[offsets[low] : offsets[high]], part))))
        return pa.array(np.concatenate(out))

    rows = docs.select(voted(F.col("text")).alias("p")).groupBy("p").count().toArrow()
    patterns = rows.column("p").to_numpy()
    order = np.argsort(patterns)
    digits = (patterns[order][:, None] // 3 ** np.arange(len(HEURISTICS))) % 3
    return digits, rows.column("count").to_numpy()[order].astype(float)


def sample_share(texts: DataFrame) -> int:
    """Of how many distinct texts one is sampled. Copies do not count: the sample has none."""
    return max(1, texts.select(F.xxhash64("text")).distinct().count() // SAMPLE_TEXTS)


def fit_quality(docs: DataFrame) -> QualityModel:
    """Label model over all documents, scorer over a sample of about ``SAMPLE_TEXTS`` texts."""
    texts = docs.select("text")
    labels = estimate(*vote_counts(texts))
    share = sample_share(texts)
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).dropDuplicates(["text"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(0))
            for low, high in blocks(offsets):
                part = offsets[low : high + 1] - offsets[low]
                own = data[offsets[low] : offsets[high]]
                values = statistics(own, part)
                rows = features(own, part, values)
                cells = binary_rows(np.full(len(rows), 4 * BUCKETS), rows.ravel())
                target = pa.array(labels.posterior(votes(values)))
                yield pa.RecordBatch.from_arrays([cells, target], ["x", "y"])

    sample = chosen.mapInArrow(emit, "x binary, y double").toArrow()
    rows = sorted(zip(sample.column("x").to_pylist(), sample.column("y").to_pylist()))
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows]).reshape(len(rows), BUCKETS)
    return QualityModel(labels, train(x, np.array([r[1] for r in rows])))


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on probabilities, by accelerated gradient steps."""
    weights = np.zeros(BUCKETS + 1)
    if not len(x):
        return weights
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # Each label weighs the same in all.
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight = weight / weight.sum()
    step = 4 / float((weight * (x**2).sum(axis=1)).sum() + RIDGE)
    ahead, before = weights.copy(), weights
    for turn in range(STEPS):
        miss = weight * (1 / (1 + np.exp(-np.clip(x @ ahead, -500, 500))) - y)
        slope = x.T @ miss + RIDGE * np.append(ahead[:-1], 0)
        weights = ahead - step * slope
        ahead = weights + turn / (turn + 3) * (weights - before)
        before = weights
    return weights


def classify(docs: DataFrame) -> DataFrame:
    """Quality of every whole text.

    Input: ``doc_id``, ``text``; other columns are ignored. Output, one row per input row:
    ``doc_id, quality`` (0 to 1), ``is_good`` (at least one half), ``good_votes, bad_votes`` and
    ``label_posterior``, the label model's own opinion.

    Defined cases: null and empty texts get one bad vote, for their length; statistics that a text
    is too short for give no vote; equal texts score alike; null or repeated ids stay as they are;
    an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    scored = score_column(fit_quality(docs), F.col("text"))
    return docs.select("doc_id", scored.alias("s")).select(
        "doc_id",
        "s.quality",
        (F.col("s.quality") >= 0.5).alias("is_good"),
        "s.good_votes",
        "s.bad_votes",
        "s.label_posterior",
    )


def score_column(model: QualityModel, text: Column) -> Column:
    @F.arrow_udf("struct<quality: double, good_votes: int, bad_votes: int, label_posterior: double>")
    def scored(texts: pa.Array) -> pa.Array:
        quality, voted, behind = model.score(texts)
        arrays = [
            pa.array(quality, pa.float64()),
            pa.array((voted == GOOD).sum(axis=1), pa.int32()),
            pa.array((voted == BAD).sum(axis=1), pa.int32()),
            pa.array(behind, pa.float64()),
        ]
        names = ["quality", "good_votes", "bad_votes", "label_posterior"]
        return pa.StructArray.from_arrays(arrays, names)

    return scored(text)


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents of good quality, all columns kept."""
    ship_package(docs.sparkSession)
    return docs.filter(score_column(fit_quality(docs), F.col("text"))["quality"] >= 0.5)
