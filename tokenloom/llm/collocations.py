"""Phrases whose words keep together, counted by broadcast double-array tries.

Levels are grown the Apriori way: a phrase is a candidate when the phrases without its last and
without its first word are, and when its occurrences, added up over all tasks, reach the threshold.
Growing follows the texts, not a join of phrases on their common words, which would be quadratic
in a common word. A trie of candidates is broadcast; a task advances the states of all
positions of a block of texts together, word by word, and adds up accepting states; the tasks'
counts are summed. A trie holds a bounded number of candidates: more are dealt by hash to several,
each with a pass of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.llm.batches import binary_rows, blocks, mix, text_bytes
from tokenloom.llm.double_array import DoubleArray, NumberTable
from tokenloom.llm.words import byte_table, hash_words, split_words
from tokenloom.session import materialize, ship_package

# Bytes that end a piece, other bytes between words, longest phrase, least count,
# scale of the score, and per cent of its count at which a longer phrase stands for a shorter.
BREAKS = (46, 44, 59, 58, 33, 63, 10, 11, 12, 13)
GAPS = (32, 9)
WORDS, SUPPORT, SCALE, COVERED = 4, 30, 2_000_000, 80
UNKNOWN = "und"
# Phrases of one trie, distinct words that a task holds before it sends them on, and bytes of text
# worked on at once; and phrases whose counts travel together.
TRIE_PHRASES, HELD_WORDS, BLOCK, VECTOR = 1 << 20, 1 << 18, 1 << 20, 1 << 12

_BREAK, _GAP = byte_table(BREAKS), byte_table(BREAKS + GAPS)


class Positions:
    """Words of a block of texts: identities (word and language) and whether the next word
    follows in the same piece.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, langs: np.ndarray) -> None:
        upper = (data >= 65) & (data <= 90)
        self.data = np.where(upper, data + np.uint8(32), data)
        self.starts, self.ends, edges = split_words(self.data, offsets, _GAP)
        self.row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        hashes = hash_words(self.data, self.starts, self.ends)
        self.words = mix(hashes ^ langs[self.row])
        breaks = np.cumsum(_BREAK[self.data], dtype=np.int64)
        piece = breaks[self.starts] if len(self.starts) else breaks[:0]
        self.joined = np.zeros(len(self.starts), np.bool_)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])

    def texts(self, which: np.ndarray) -> pa.Array:
        """The chosen words as strings."""
        low, size = self.starts[which], (self.ends - self.starts)[which]
        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.arange(edges[-1]) + np.repeat(low - edges[:-1], size)
        return pa.Array.from_buffers(
            pa.large_string(), len(which), [None, pa.py_buffer(edges), pa.py_buffer(self.data[at])]
        ).cast(pa.string())


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[Positions, pa.Array]]:
    """Words of each block of a batch ``(lang, text)``, and its rows' languages."""
    offsets, data = text_bytes(batch.column("text"))
    names = batch.column("lang").dictionary_encode()
    known = np.array([_lang_hash(n) for n in names.dictionary.to_pylist()], np.uint64)
    langs = known[names.indices.to_numpy(zero_copy_only=False)]
    for low, high in blocks(offsets, BLOCK):
        part = offsets[low : high + 1]
        own = Positions(part - part[0], data[part[0] : part[-1]], langs[low:high])
        yield own, batch.column("lang").slice(low, high - low)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of each one's counts, and a place of each."""
    by = np.argsort(keys, kind="stable")
    ranked = keys[by]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(by)), np.bool_), ranked[1:] != ranked[:-1]]))
    return ranked[first], np.add.reduceat(counts[by], first) if len(first) else counts[:0], by[first]


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word_id, lang, word, n)`` of all words. ``texts`` is ``(lang, text)`` without nulls."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

        def joined() -> pa.RecordBatch:
            ids, counts, langs, words = zip(*held)
            ids, counts, at = _summed(np.concatenate(ids), np.concatenate(counts))
            at = pa.array(at)
            columns = [pa.concat_arrays(c).take(at) for c in (langs, words)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64)), *columns, pa.array(counts)],
                ["word_id", "lang", "word", "n"],
            )

        for batch in batches:
            for own, langs in _blocks(batch):
                ids, counts, at = _summed(own.words, np.ones(len(own.words), np.int64))
                rows = pa.array(own.row[at])
                held.append((ids, counts, langs.take(rows), own.texts(at)))
            if sum(len(h[0]) for h in held) > HELD_WORDS:
                yield joined()
                held.clear()
        if held:
            yield joined()

    rows = texts.mapInArrow(emit, "word_id long, lang string, word string, n long")
    return rows.groupBy("word_id", "lang", "word").agg(F.sum("n").alias("n"))


class PhraseTrie:
    """A trie of phrases for the tasks. ``whole`` says that it holds every phrase of its length, so
    that a phrase it does not hold is no candidate.
    """

    def __init__(self, rows: list[tuple[int, list[int]]], whole: bool) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        lengths = np.array([len(r[1]) for r in rows], np.int64)
        flat = np.array([w for r in rows for w in r[1]], np.int64).view(np.uint64)
        vocabulary, symbols = np.unique(flat, return_inverse=True)
        paths = np.zeros((len(rows), int(lengths.max(initial=1))), np.int64)
        paths[np.arange(paths.shape[1]) < lengths[:, None]] = symbols + 1
        self.table = NumberTable(vocabulary)
        self.vocabulary = vocabulary
        self.trie = DoubleArray(paths, len(vocabulary) + 1)
        self.depth, self.whole = paths.shape[1], whole

    def states(self, own: Positions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Level by level, the state of every position after so many words, and the symbols."""
        symbols = self.table.find(own.words)
        state = np.zeros(len(symbols), np.int64)
        reach = np.ones(len(symbols), np.bool_)
        for level in range(self.depth):
            ahead = np.zeros(len(symbols), np.int64)
            ahead[: max(0, len(symbols) - level)] = symbols[level:]
            state = self.trie.step(state, np.where(reach, ahead, 0))
            yield state, symbols
            # A phrase goes on while its words follow each other in one piece.
            later = np.zeros(len(symbols), np.bool_)
            later[: max(0, len(symbols) - level)] = own.joined[level:]
            reach = reach & later


def _extensions(trie: PhraseTrie, own: Positions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, next word, times) of every occurrence of a phrase of the trie's full length that
    another word follows, such that the phrase from its second word on is a candidate too.
    """
    state, size = None, trie.depth
    for state, _symbols in trie.states(own):
        pass
    end = trie.trie.ends[state]
    room = max(0, len(end) - size)
    # Word size positions ahead follows in the same piece.
    follows = np.ones(room, np.bool_)
    for k in range(size):
        follows &= own.joined[k : k + room]
    good = follows & (end[:room] >= 0)
    if trie.whole:
        good &= end[1 : room + 1] >= 0
    at = np.flatnonzero(good)
    phrase, word = end[at].astype(np.int64), own.words[at + size]
    if trie.whole:
        key = (phrase << 32) | trie.table.find(word)
        keys, counts, first = _summed(key, np.ones(len(key), np.int64))
        return phrase[first], word[first], counts
    by = np.lexsort((word, phrase))
    phrase, word = phrase[by], word[by]
    new = np.ones(len(by), np.bool_)
    new[1:] = (phrase[1:] != phrase[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return phrase[first], word[first], np.diff(np.append(first, len(by)))


def _tries(
    spark: SparkSession, phrases: DataFrame, limit: int
) -> Iterator[PhraseTrie]:
    """Tries over stored ``phrases (phrase_id, path)``, at most about ``limit`` in each."""
    count = phrases.count()
    parts = -(-count // limit)
    for part in range(parts):
        own = phrases
        if parts > 1:
            own = phrases.filter(F.pmod(F.xxhash64("phrase_id"), F.lit(parts)) == part)
        rows = own.select("phrase_id", "path").toArrow()
        yield PhraseTrie(
            list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), parts == 1
        )


def _passed(
    texts: DataFrame,
    tries: Iterator[PhraseTrie],
    emit: Callable[[PhraseTrie, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    combine: Callable[[DataFrame, Broadcast], DataFrame],
    name: str,
) -> DataFrame | None:
    """One pass over the texts with each trie, every pass a stage table."""
    found = None
    for trie in tries:
        shared = texts.sparkSession.sparkContext.broadcast(trie)
        part = texts.mapInArrow(lambda batches, shared=shared: emit(shared.value, batches), schema)
        part = materialize(combine(part, shared), name)
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def longer_phrases(
    texts: DataFrame, phrases: DataFrame, words: DataFrame, support: int, limit: int
) -> DataFrame:
    """Candidates of one word more: ``(phrase_id, lang, phrase, path)``, as ``phrases`` is."""
    spark = texts.sparkSession

    def emit(trie: PhraseTrie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, _ in _blocks(batch):
                phrase, word, counts = _extensions(trie, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trie.ids[phrase]), pa.array(word.view(np.int64)), pa.array(counts)],
                    ["phrase_id", "word_id", "n"],
                )

    def combine(rows: DataFrame, shared: Broadcast) -> DataFrame:
        met = rows.groupBy("phrase_id", "word_id").agg(F.sum("n").alias("n"))
        return met.filter(F.col("n") >= support)

    found = _passed(
        texts,
        _tries(spark, phrases, limit),
        emit,
        "phrase_id long, word_id long, n long",
        combine,
        "phrase-extensions",
    )
    if found is None:
        return phrases.limit(0)
    added = words.select("word_id", "word")
    grown = found.join(phrases, "phrase_id").join(added, "word_id").select(
        "lang",
        F.concat_ws(" ", "phrase", "word").alias("phrase"),
        F.concat("path", F.array("word_id")).alias("path"),
    )
    # Where one trie did not hold all phrases, the rest of a phrase is looked up here.
    rest = phrases.select(F.col("path").alias("_rest"))
    size = F.size("path")
    grown = grown.withColumn("_rest", F.slice("path", F.lit(2), size - 1)).join(
        rest, "_rest", "left_semi"
    )
    return _numbered(grown.select("lang", "phrase", "path"))


def _numbered(phrases: DataFrame) -> DataFrame:
    rows = phrases.withColumn("phrase_id", F.monotonically_increasing_id())
    return materialize(rows, "phrases")


def phrase_counts(texts: DataFrame, phrases: DataFrame, limit: int) -> DataFrame | None:
    """``(phrase_id, f)``: occurrences of every phrase, added up from the tasks' counts of accepting
    states. A task's counts travel as vectors of ``VECTOR`` phrases, without those of zeros only,
    and equal parts of all tasks are summed as vectors.
    """

    def emit(trie: PhraseTrie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = -(-len(trie.ids) // VECTOR)
        total = np.zeros(parts * VECTOR + 1, np.int64)
        for batch in batches:
            for own, _ in _blocks(batch):
                for state, _ in trie.states(own):
                    # Cell 0 counts the positions that end no phrase.
                    total += np.bincount(trie.trie.ends[state] + 1, minlength=len(total))
        vectors = total[1:].reshape(parts, VECTOR)
        some = np.flatnonzero(vectors.any(axis=1))
        cells = binary_rows(np.full(len(some), 8 * VECTOR), vectors[some].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), cells], ["part", "counts"])

    def combine(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, np.zeros(VECTOR, np.int64)
            for batch in batches:
                for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if part != at:
                        if at is not None:
                            yield counted(at, total)
                        at, total = part, np.zeros(VECTOR, np.int64)
                    total += np.frombuffer(counts.as_buffer(), np.int64)
            if at is not None:
                yield counted(at, total)

        def counted(part: int, total: np.ndarray) -> pa.RecordBatch:
            ids = shared.value.ids[part * VECTOR : (part + 1) * VECTOR]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(total[: len(ids)])], ["phrase_id", "f"]
            )

        placed = rows.repartition("part").sortWithinPartitions("part")
        return placed.mapInArrow(summed, "phrase_id long, f long")

    return _passed(
        texts,
        _tries(texts.sparkSession, phrases, limit),
        emit,
        "part int, counts binary",
        combine,
        "phrase-counts",
    )


PHRASES = "lang string, phrase string, size int, f long, n long"


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, limit: int = TRIE_PHRASES
) -> DataFrame:
    """``(lang, phrase, size, f, n)`` of every phrase of up to ``WORDS`` words that occurs
    ``support`` times in its language; ``n`` is the language's number of words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.filter("text is not null").select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text"
    )
    counted = materialize(word_counts(texts), "word-counts")
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.filter(F.col("n") >= support)
    level = _numbered(
        words.select("lang", F.col("word").alias("phrase"), F.array("word_id").alias("path"))
    )
    grown = []
    for _ in range(WORDS - 1):
        level = longer_phrases(texts, level, words, support, limit)
        grown.append(level)
    longer = grown[0]
    for level in grown[1:]:
        # Numbers are unique within a length only.
        longer = longer.unionByName(level)
    longer = _numbered(longer.drop("phrase_id"))
    counts = phrase_counts(texts, longer, limit)
    found = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    if counts is not None:
        more = longer.join(counts, "phrase_id")
        found = found.unionByName(more.select("lang", "phrase", F.size("path").alias("size"), "f"))
    return found.filter(F.col("f") >= support).join(sizes, "lang")


def score_phrases(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, size, a, l, r, n, score)`` of every phrase of two words or more: the cut
    into two parts that scores lowest, and of equal ones the earliest. ``phrases`` is stored, as
    ``frequent_phrases`` gives them.
    """
    words = F.split("phrase", " ", -1)
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    whole = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), "n", cut)
    part = lambda low, size: F.array_join(F.slice(words, low, size), " ")
    whole = whole.withColumn("_left", part(F.lit(1), F.col("k"))).withColumn(
        "_right", part(F.col("k") + 1, F.col("size") - F.col("k"))
    )
    for side, name in (("_left", "l"), ("_right", "r")):
        parts = phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        whole = whole.join(parts, ["lang", side])
    # Products may pass 64 bits.
    scaled = F.expr(f"cast(cast(a as decimal(38, 0)) * {SCALE} div (l + r) as long)")
    best = F.min(F.struct(scaled.alias("score"), "k", "l", "r")).alias("best")
    scored = whole.groupBy("lang", "phrase", "size", "a", "n").agg(best)
    return scored.select("lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score")


def without_parts(scored: DataFrame, covered: int = COVERED) -> DataFrame:
    """Phrases without those whose words stand inside a longer one that has at least ``covered``
    per cent of their occurrences.
    """
    words = F.split("phrase", " ", -1)
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("size") - size + 1),
                lambda low: F.array_join(F.slice(words, low, size), " "),
            ),
        )
    )
    longer = scored.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    wide = lambda name, by: F.col(name).cast("decimal(38,0)") * by
    stands = F.coalesce(wide("_most", 100) >= wide("a", covered), F.lit(False))
    return scored.join(most, ["lang", "phrase"], "left").filter(~stands).drop("_most")


def collocations(docs: DataFrame, top: int = 2000, limit: int = TRIE_PHRASES) -> DataFrame:
    """The ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Input: ``lang, text``; other columns are ignored. Letters A-Z are lowered; texts are split into
    pieces at ``BREAKS`` and these into words at spaces and tabs; phrases lie within a piece. A
    phrase's score is that of its lowest-scoring cut, ``SCALE * a / (l + r)`` rounded down.

    Defined cases: null and empty texts have no words; a null ``lang`` is ``und``; equal scores go
    by count, then by the phrase's bytes; repeated rows count each; an empty table, or one in which
    nothing occurs often enough, gives an empty result. Words are told apart by 64-bit hashes.
    """
    phrases = materialize(frequent_phrases(docs, SUPPORT, limit), "frequent-phrases")
    scored = materialize(score_phrases(phrases), "phrase-scores")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_parts(scored).withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
