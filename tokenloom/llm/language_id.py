"""Language identification with blended-spectrum presence kernels.

The kernel of two texts is the number of byte n-grams (n from 1 to 3) that occur in both, divided
by the geometric mean of their distinct n-gram counts. Nystroem landmarks turn it into a feature
map, one-versus-rest kernel ridge regression is fitted on a bounded sample, and whole texts are
scored by two matrix products per block: presence x landmarks, then kernel values x weights.

The scores of a text sum to one, so some language always wins, and that is the prediction. Whether
a text is in any language, which only a filter asks, is told by another measure: the share of its
three-byte strings that occur in some landmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.llm.batches import binary_rows, release, text_bytes
from tokenloom.session import local_table, ship_package

# Codes of n-grams of one, two and three bytes, one range after the other.
BIGRAMS, TRIGRAMS = 1 << 8, (1 << 8) + (1 << 16)
CODES = TRIGRAMS + (1 << 24)
# Bounds of the fitted sample: labelled texts in all, per language, and landmarks per language.
SAMPLE_ROWS, SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 20_000, 256, 32
RIDGE = 1e-3
# Rows per matrix product, and bytes of a long text read at once.
PRODUCT_ROWS, PIECE_BYTES = 64, 1 << 20
UNKNOWN = "und"
# Below this score no language claims a text.
MIN_SCORE = 0.2
# A language claims a text whose share of known trigrams reaches this part of what all but the given
# portion of the language's fitted texts reach.
KNOWN_PART, KNOWN_QUANTILE = 0.5, 0.01

# The work table of the batch at hand: a model and the trigrams known to it. It is large, so that
# none stays in an idle worker.
_TABLES: list[tuple[LanguageModel, np.ndarray]] = []


def _codes(piece: np.ndarray) -> np.ndarray:
    one = piece.astype(np.int32)
    two = (one[:-1] << 8) | one[1:]
    three = (two[:-1] << 8) | one[2:]
    return np.concatenate([one, two + BIGRAMS, three + TRIGRAMS])


def distinct_codes(text: np.ndarray) -> np.ndarray:
    """Distinct n-gram codes of a whole text, in order. Pieces of a long text are sorted one by one,
    so that nothing is held beside a piece's codes and the distinct ones so far.
    """
    found = np.empty(0, np.int32)
    for low in range(0, max(1, len(text)), PIECE_BYTES):
        codes = np.unique(_codes(text[low : low + PIECE_BYTES + 2]))
        found = np.union1d(found, codes) if len(found) else codes
    return found


def trigrams(text: np.ndarray) -> Iterator[np.ndarray]:
    """Every three bytes of a text between two spaces, as numbers, piece by piece."""
    text = np.concatenate([[32], text, [32]]).astype(np.int32)
    for low in range(0, len(text) - 2, PIECE_BYTES):
        piece = text[low : low + PIECE_BYTES + 2]
        yield (piece[:-2] << 16) | (piece[1:-1] << 8) | piece[2:]


@dataclass
class LanguageModel:
    """Scores of each language as linear functions of the kernel values with the landmarks."""

    languages: list[str]
    vocabulary: np.ndarray  # sorted codes of the landmarks
    landmarks: np.ndarray  # presence of each code in each landmark, over the root of its count
    weights: np.ndarray  # kernel values and a constant to languages
    levels: np.ndarray  # least share of known trigrams in a text of each language

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        kernel = self.kernel([distinct_codes(text) for text in texts])
        return kernel @ self.weights[:-1] + self.weights[-1]

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        presence = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        sizes = np.ones(len(rows), np.float32)
        for i, codes in enumerate(rows):
            at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
            presence[i, at[self.vocabulary[at] == codes]] = 1
            sizes[i] = max(1, len(codes))
        return (presence @ self.landmarks) / np.sqrt(sizes)[:, None]

    def claims(self, text: np.ndarray, language: int) -> bool:
        """Whether enough of the text's trigrams are known for it to be in the language. A share of
        few trigrams may fall short by the greatest standard deviation that a share of so many has.
        """
        known = self._known()
        hits = total = 0
        for codes in trigrams(text):
            hits += int(np.count_nonzero(known[codes]))
            total += len(codes)
        return hits / total >= self.levels[language] - 0.5 / np.sqrt(total)

    def _known(self) -> np.ndarray:
        if not _TABLES or _TABLES[0][0] is not self:
            known = np.zeros(1 << 24, np.bool_)
            known[self.vocabulary[self.vocabulary >= TRIGRAMS] - TRIGRAMS] = True
            _TABLES[:] = [(self, known)]
        return _TABLES[0][1]

    def predict(self, text: Column, claim: bool = False) -> Column:
        """``struct<lang_pred, score, claimed>`` of a text: the language of greatest score, and,
        where asked, whether it claims the text. A text that is null or has no letter is ``und`` with score 0,
        and so is every text when no language was learned.
        """
        model = self

        @F.arrow_udf("struct<lang_pred: string, score: double, claimed: boolean>")
        def scored(lowered: pa.Array) -> pa.Array:
            try:
                return model._scored(lowered, claim)
            finally:
                model._forget()
                release()

        return scored(F.when(text.rlike(r"\p{L}"), F.lower(text)))

    def _scored(self, lowered: pa.Array, claim: bool) -> pa.Array:
        known = np.asarray(lowered.is_valid())
        offsets, data = text_bytes(lowered)
        best = np.full(len(lowered), len(self.languages))
        value = np.zeros(len(lowered))
        claimed = np.zeros(len(lowered), np.bool_)
        rows = np.flatnonzero(known) if self.languages else np.empty(0, int)
        for low in range(0, len(rows), PRODUCT_ROWS):
            part = rows[low : low + PRODUCT_ROWS]
            texts = [data[offsets[i] : offsets[i + 1]] for i in part]
            got = self.scores(texts)
            best[part] = got.argmax(axis=1)
            value[part] = np.clip(got.max(axis=1), 0, 1)
            if claim:
                claimed[part] = [self.claims(t, i) for t, i in zip(texts, best[part])]
        names = pa.array([*self.languages, UNKNOWN], pa.string())
        return pa.StructArray.from_arrays(
            [names.take(pa.array(best)), pa.array(value), pa.array(claimed)],
            ["lang_pred", "score", "claimed"],
        )

    @staticmethod
    def _forget() -> None:
        """Empty the worker's own table; the function that is sent to it has copies of what it names."""
        _TABLES.clear()


def held_out() -> Column:
    """Documents that are never learned from."""
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return digest % 5 == 0


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Fit on labelled texts that are not held out.

    The sample is bounded: per language the ``SAMPLE_PER_LANGUAGE`` distinct texts of least hash
    (fewer when there are very many languages), of which the first are landmarks. Only their
    n-gram codes come to the driver.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()
    )
    labelled = labelled.withColumn("h", F.xxhash64("text"))
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], np.empty(0, int), np.empty((0, 0)), np.empty((1, 0)), np.empty(0))
    each = max(4, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(languages)))
    # Least hashes per language and salt first, then per language: no language meets in one task.
    texts = labelled.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(61)))
    salted = Window.partitionBy("lang", "salt").orderBy("h")
    texts = texts.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= each)
    whole = Window.partitionBy("lang").orderBy("h")
    texts = texts.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= each)
    chosen = [(r["lang"], r["h"]) for r in texts.select("lang", "h").collect()]
    chosen = F.broadcast(local_table(docs.sparkSession, chosen, "lang string, h long"))
    sample = labelled.join(chosen, ["lang", "h"]).groupBy("lang", "h")
    sample = sample.agg(F.min(F.lower("text")).alias("text"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            found = [distinct_codes(data[low:high]) for low, high in zip(offsets[:-1], offsets[1:])]
            times = [
                _times(data[low:high], c)
                for low, high, c in zip(offsets[:-1], offsets[1:], found)
            ]
            lengths = np.array([4 * len(c) for c in found], np.int64)
            columns = [
                binary_rows(lengths, np.concatenate([*part, np.empty(0, np.int32)]))
                for part in (found, times)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), *columns], ["lang", "h", "codes", "times"]
            )

    rows = sample.mapInArrow(codes, "lang string, h long, codes binary, times binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["h"]))
    found = ([np.frombuffer(r[name], np.int32) for r in rows] for name in ("codes", "times"))
    return fit([r["lang"] for r in rows], *found)


def _times(text: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """How often the text, between two spaces, holds each of the codes that is a trigram."""
    order = np.argsort(codes)
    ranked = codes[order]
    counts = np.zeros(len(codes), np.int32)
    for found in trigrams(text):
        at = np.minimum(np.searchsorted(ranked, found + TRIGRAMS), len(codes) - 1)
        at = at[ranked[at] == found + TRIGRAMS]
        counts[order] += np.bincount(at, minlength=len(codes)).astype(np.int32)
    return counts


def fit(labels: list[str], texts: list[np.ndarray], times: list[np.ndarray]) -> LanguageModel:
    """Nystroem features of the sample, one ridge regression per language, and the levels of known
    trigrams. ``times`` says how often a text holds each of its codes.
    """
    languages = sorted(set(labels))
    marks: list[np.ndarray] = []
    for language in languages:
        marks += [t for t, l in zip(texts, labels) if l == language][:LANDMARKS_PER_LANGUAGE]
    vocabulary = np.unique(np.concatenate(marks))
    landmarks = np.zeros((len(vocabulary), len(marks)), np.float32)
    for j, codes in enumerate(marks):
        landmarks[np.searchsorted(vocabulary, codes), j] = 1 / np.sqrt(max(1, len(codes)))
    model = LanguageModel(languages, vocabulary, landmarks, np.empty(0), np.empty(0))
    model.levels = known_levels(labels, texts, times, marks, vocabulary)
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    to_features = vectors[:, kept] / np.sqrt(values[kept])
    features = np.vstack(
        [model.kernel(texts[i : i + PRODUCT_ROWS]) for i in range(0, len(texts), PRODUCT_ROWS)]
    )
    features = np.hstack([features @ to_features, np.ones((len(texts), 1))])
    targets = (np.array(labels)[:, None] == np.array(languages)[None, :]).astype(np.float64)
    # Every language weighs the same, however many of its texts the sample holds.
    weight = (targets / targets.sum(axis=0)).sum(axis=1)[:, None]
    gram = features.T @ (weight * features)
    penalty = RIDGE * np.eye(len(gram)) * np.trace(gram) / len(gram)
    penalty[-1, -1] = 0
    solved = np.linalg.solve(gram + penalty, features.T @ (weight * targets))
    weights = np.vstack([to_features @ solved[:-1], solved[-1:]])
    model.weights = weights.astype(np.float32)
    return model


def known_levels(
    labels: list[str],
    texts: list[np.ndarray],
    times: list[np.ndarray],
    marks: list[np.ndarray],
    vocabulary: np.ndarray,
) -> np.ndarray:
    """Of each language, the share of known trigrams from which it claims a text. A landmark's own
    trigrams count as known only when another landmark has them. A language of which one text alone
    is known, or texts without trigrams, gets a low level: it cannot tell.
    """
    held = np.zeros(len(vocabulary), np.int32)
    for codes in marks:
        held[np.searchsorted(vocabulary, codes)] += 1
    own = {id(codes) for codes in marks}
    shares: dict[str, list[float]] = {}
    for label, codes, count in zip(labels, texts, times):
        at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
        known = (vocabulary[at] == codes) & (held[at] > (id(codes) in own))
        of_three = codes >= TRIGRAMS
        total = count[of_three].sum()
        if total:
            shares.setdefault(label, []).append(count[of_three & known].sum() / total)
    return np.array(
        [
            KNOWN_PART * np.quantile(shares[language], KNOWN_QUANTILE) if language in shares else 0.0
            for language in sorted(set(labels))
        ]
    )


def identify(docs: DataFrame) -> DataFrame:
    """Predicted language of every whole text.

    Input: ``doc_id, text, lang``; other columns are ignored. Output, one row per input row:
    ``doc_id, held_out, lang_pred, score``.

    Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is every
    text when no labelled row may be learned from; any other text gets the learned language of
    greatest score, also one in none of them; a tie goes to the language that sorts first; a null
    ``doc_id`` hashes as an empty one; equal texts get equal predictions; an empty table gives an
    empty result.
    """
    ship_package(docs.sparkSession)
    model = fit_languages(docs)
    scored = docs.select("doc_id", held_out().alias("held_out"), model.predict(F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents that the language of their greatest score claims, with a score of at least
    ``min_score``. All columns are kept; the label column only feeds the fit. No shuffle of texts.

    Null, empty and letterless texts go, as do texts in no learned language (other scripts, random
    letters, encoded bytes), and all texts where no labelled row may be learned from; equal texts,
    of any length, have one fate; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    found = fit_languages(docs).predict(F.col("text"), claim=True)
    return docs.filter(found["claimed"] & (found["score"] >= min_score))
