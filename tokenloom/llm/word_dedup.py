"""Removal of runs of words that an earlier document holds, by FM-indexes over shards of stretches.

Every 13-word window has an anchor (its least-hash five-word gram), at a place that its words alone
decide, so equal windows have equal anchors. Windows whose anchor occurs in one text only are
unlike all others. The rest travel, as stretches of windows with one anchor, to the shard of that
anchor. A shard's distinct stretches are indexed (Burrows-Wheeler transform in a wavelet tree) and
streamed against that index: backward search, cut off at 13 words, gives for every window the
suffixes that begin with it, and the least document among their texts. Windows with an earlier one
are reported as intervals.

An anchor with very many occurrences would make a shard of any size. Its windows travel one by one
instead, each to the shard of its own words, where equal ones are all that meet. Copies never
travel together: equal texts are one text, and of equal stretches of a block only the earliest
is sent, the others being repeats already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.llm.batches import blocks, mix, text_bytes
from tokenloom.llm.common_keys import common_keys
from tokenloom.llm.fm_index import FMIndex, least_within
from tokenloom.llm.shuffles import dropped_shuffles
from tokenloom.llm.words import SPACES, byte_table, hash_words, runs_of, split_words
from tokenloom.session import materialize, ship_package

# Words of a window, words of an anchor, and anchors to choose from in a window.
LENGTH, GRAM = 13, 5
CHOICES = LENGTH - GRAM + 1
# Bytes of a text below which it holds no window.
LEAST_BYTES = 2 * LENGTH - 1
# Bytes of text worked on at once, and words that one index covers, about.
BLOCK, SHARD_WORDS = 1 << 20, 1 << 19
# Rows that wait in a shard before equal ones are put together.
WAITING_ROWS = 20_000
# Occurrences beyond which the windows of an anchor travel one by one.
CROWDED = 1 << 15
# An anchor is sent as 48 bits of its hash; a flag above them marks a crowded one.
KEY_SHIFT, CROWDED_BIT = np.uint64(16), np.int64(1 << 62)
UPPER = np.uint64(0xFFFFFFFF00000000)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_GAPS = byte_table(SPACES)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbouring words."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        out = out * _STEP + words[k : k + len(out)]
    return mix(out)


def stretches(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: the anchor's hash, the first window's first word, the
    number of windows, and the row. ``edges`` are the rows' word offsets.
    """
    windows = len(words) - LENGTH + 1
    if windows <= 0:
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty, empty, empty
    grams = _grams(words, GRAM)
    # The leftmost of the least hashes, by their upper halves; the lower half is the place.
    least = (grams & UPPER) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= CHOICES:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:windows], least[CHOICES - span : CHOICES - span + windows])
    anchor = (least & ~UPPER).astype(np.int64)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:windows]
    inside = np.arange(windows) + LENGTH <= edges[row + 1]
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    ends = np.cumsum(inside)
    before = ends[first] - 1
    counts = np.diff(np.append(before, ends[-1]))
    return grams[anchor[first]], first, counts, row[first]


def _word_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word offsets of the rows) of each block of a batch."""
    offsets, data = text_bytes(texts)
    for low, high in blocks(offsets, BLOCK):
        part = offsets[low : high + 1]
        own = data[part[0] : part[-1]]
        starts, ends, edges = split_words(own, part - part[0], _GAPS)
        yield low, hash_words(own, starts, ends), edges


def anchor_keys(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct anchors of every text."""
    for _, words, edges in _word_blocks(texts):
        hashes, _, _, row = stretches(words, edges)
        cuts = np.searchsorted(row, np.arange(len(edges)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield np.unique(hashes[a:b])


def _is_in(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ranked):
        return np.zeros(len(values), np.bool_)
    at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
    return ranked[at] == values


def _fresh(batch: pa.RecordBatch) -> np.ndarray:
    """The first row of each distinct text of a batch."""
    ids = np.stack([batch.column(c).to_numpy() for c in ("ta", "tb")], axis=1)
    fresh = np.zeros(len(ids), np.bool_)
    fresh[np.unique(ids, axis=0, return_index=True)[1]] = True
    return fresh


def shared_anchors(texts: DataFrame, common: np.ndarray, crowded: int = CROWDED) -> DataFrame:
    """``(ta, tb, anchors)``: the anchors of a text that another text has too, crowded ones
    flagged, without those of the common list. ``texts`` is ``(ta, tb, text)``; equal texts have
    equal ids.
    """
    skipped = np.sort(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = (batch.column(c).to_numpy() for c in ("ta", "tb"))
            fresh = _fresh(batch)
            for low, words, edges in _word_blocks(batch.column("text")):
                hashes, _, _, row = stretches(words, edges)
                kept = fresh[low + row] & ~_is_in(hashes, skipped)
                hashes, row = (hashes[kept] >> KEY_SHIFT).view(np.int64), row[kept]
                by = np.lexsort((hashes, row))
                hashes, row = hashes[by], row[by]
                new = np.ones(len(by), np.bool_)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(by)))
                owner = low + row[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[at]),
                        pa.array(ta[owner]),
                        pa.array(tb[owner]),
                        pa.array(times.astype(np.int32)),
                    ],
                    ["anchor", "ta", "tb", "times"],
                )

    rows = texts.mapInArrow(emit, "anchor long, ta long, tb long, times int")
    over = Window.partitionBy("anchor")
    ends = [f(c).over(over).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("ta", "tb")]
    rows = rows.select("anchor", "ta", "tb", F.sum("times").over(over).alias("met"), *ends)
    rows = rows.filter("min_ta < max_ta or min_tb < max_tb")
    flagged = F.when(
        F.col("met") > crowded, F.col("anchor").bitwiseOR(F.lit(int(CROWDED_BIT)))
    ).otherwise(F.col("anchor"))
    return rows.groupBy("ta", "tb").agg(F.collect_set(flagged).alias("anchors"))


UNIT = (
    "key long, rank long, ta long, tb long, starts array<int>, windows int, words binary"
)
UNIT_NAMES = ["key", "rank", "ta", "tb", "starts", "windows", "words"]


def _content_hashes(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each of the word sequences that lie end to end in ``words``."""
    if not len(sizes):
        empty = np.empty(0, np.uint64)
        return empty, empty
    edges = np.cumsum(sizes) - sizes
    place = runs_of(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64)
    return tuple(
        np.add.reduceat(mix(words ^ mix((place + np.uint64(1)) * seed)), edges)
        + sizes.astype(np.uint64) * seed
        for seed in _SEEDS
    )


def text_units(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """Stretches of the texts' shared anchors, and single windows of crowded and common ones, as
    ``UNIT``. ``texts`` is ``(ta, tb, rank, text, anchors)``, a text's rank being its smallest
    document.

    Of equal stretches in a block only those of the texts of least rank are sent on, one row per
    text; the others are repeats and leave as finished cuts, without words.
    """
    skipped = np.sort(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb, rank = (batch.column(c).to_numpy() for c in ("ta", "tb", "rank"))
            lists = batch.column("anchors")
            fresh = _fresh(batch)
            for low, words, edges in _word_blocks(batch.column("text")):
                hashes, first, counts, row = stretches(words, edges)
                part = lists.slice(low, len(edges) - 1)
                sizes = part.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64))
                crowded = (flat & CROWDED_BIT) != 0
                known = mix((flat & ~CROWDED_BIT).view(np.uint64)) ^ owner
                own = mix(hashes >> KEY_SHIFT) ^ mix(row.astype(np.uint64))
                usable = fresh[low + row]
                single = usable & (_is_in(hashes, skipped) | _is_in(own, np.sort(known[crowded])))
                whole = usable & ~single & _is_in(own, np.sort(known[~crowded]))
                # Single windows of the crowded anchors, each keyed by its own words.
                alone = runs_of(first[single], counts[single])
                start = np.concatenate([first[whole], alone])
                count = np.concatenate([counts[whole], np.ones(len(alone), np.int64)])
                of = np.concatenate([row[whole], np.repeat(row[single], counts[single])])
                if not len(start):
                    continue
                size = count + LENGTH - 1
                content = words[runs_of(start, size)]
                h1, h2 = _content_hashes(content, size)
                key = np.concatenate([hashes[whole] >> KEY_SHIFT, h1[int(whole.sum()) :]])
                yield _unit_rows(
                    key, h1, h2, low + of, rank, ta, tb, start - edges[of], count, size, content
                )

    return texts.mapInArrow(emit, UNIT)


def _unit_rows(key, h1, h2, of, rank, ta, tb, start, count, size, content) -> pa.RecordBatch:
    """One row per content and text of a block."""
    by = np.lexsort((start, of, rank[of], h2, h1))
    same = np.ones(len(by), np.bool_)
    same[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    group = np.cumsum(same) - 1
    ranks = rank[of[by]]
    least = ranks[np.flatnonzero(same)][group]
    new = same.copy()
    new[1:] |= of[by][1:] != of[by][:-1]
    at = np.flatnonzero(new)
    which = by[at]
    done = ranks[at] > least[at]
    owner = of[which]
    edges = np.cumsum(size) - size
    sent = np.where(done, 0, size[which])
    data = content[runs_of(edges[which], sent)]
    offsets = np.concatenate([[0], np.cumsum(8 * sent)]).astype(np.int64)
    cells = pa.Array.from_buffers(
        pa.large_binary(),
        len(which),
        [pa.array(~done).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(data)],
    )
    starts = pa.ListArray.from_arrays(
        pa.array(np.append(at, len(by)).astype(np.int32)), pa.array(start[by].astype(np.int32))
    )
    # Finished cuts go to any task.
    spread = mix(ta[owner].view(np.uint64) + start[which].astype(np.uint64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(done, spread, key[which]).view(np.int64)),
            pa.array(rank[owner]),
            pa.array(ta[owner]),
            pa.array(tb[owner]),
            starts,
            pa.array(count[which].astype(np.int32)),
            cells.cast(pa.binary()),
        ],
        UNIT_NAMES,
    )


class Units:
    """Rows of units as arrays: ids, lists of starts, and words."""

    def __init__(self, key, rank, ta, tb, windows, start_sizes, starts, words) -> None:
        self.key, self.rank, self.ta, self.tb, self.windows = key, rank, ta, tb, windows
        self.start_sizes, self.starts, self.words = start_sizes, starts, words
        self.sizes = windows + LENGTH - 1

    @staticmethod
    def of(batch: pa.RecordBatch) -> Units:
        columns = [batch.column(c).to_numpy() for c in ("key", "rank", "ta", "tb", "windows")]
        lists = batch.column("starts")
        raw = batch.column("words").cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = raw.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        words = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint64)
        return Units(
            *columns[:4],
            columns[4].astype(np.int64),
            lists.value_lengths().to_numpy().astype(np.int64),
            lists.flatten().to_numpy().astype(np.int64),
            words,
        )

    def __len__(self) -> int:
        return len(self.key)

    def take(self, rows: np.ndarray) -> Units:
        firsts = np.cumsum(self.start_sizes) - self.start_sizes
        edges = np.cumsum(self.sizes) - self.sizes
        return Units(
            *[c[rows] for c in (self.key, self.rank, self.ta, self.tb, self.windows)],
            self.start_sizes[rows],
            self.starts[runs_of(firsts[rows], self.start_sizes[rows])],
            self.words[runs_of(edges[rows], self.sizes[rows])],
        )

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        names = ("key", "rank", "ta", "tb", "windows", "start_sizes", "starts", "words")
        return Units(*[np.concatenate([getattr(p, n) for p in parts]) for n in names])

    def cuts(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """Word ranges of the texts: windows ``[low, high)`` of the units ``rows``, at all of
        their starts.
        """
        times = self.start_sizes[rows]
        firsts = np.cumsum(self.start_sizes) - self.start_sizes
        start = self.starts[runs_of(firsts[rows], times)]
        owner = np.repeat(rows, times)
        return _cut_rows(
            self.ta[owner],
            self.tb[owner],
            start + np.repeat(low, times),
            start + np.repeat(high, times) + LENGTH - 1,
        )


def _cut_rows(ta, tb, low, high) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ta), pa.array(tb), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
        ["ta", "tb", "low", "high"],
    )


def settle_equal(units: Units) -> tuple[Units, np.ndarray, pa.RecordBatch]:
    """Of equal units only those of least rank, their contents as numbers, and the cuts of the
    others, which are repeats as a whole.
    """
    h1, h2 = _content_hashes(units.words, units.sizes)
    by = np.lexsort((units.rank, h2, h1))
    new = np.ones(len(by), np.bool_)
    new[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    content = np.cumsum(new) - 1
    least = units.rank[by][np.flatnonzero(new)][content]
    repeat = units.rank[by] > least
    rows = by[repeat]
    cuts = units.cuts(np.zeros(len(rows), np.int64), units.windows[rows], rows)
    return units.take(by[~repeat]), content[~repeat], cuts


def repeated_intervals(units: Units, content: np.ndarray) -> pa.RecordBatch:
    """Cuts of a whole shard: its distinct stretches are indexed and streamed against the index.

    ``content`` numbers the units' contents from 0, equal ones next to each other.
    """
    first = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
    kept = units.take(first)
    vocabulary, symbols = np.unique(kept.words, return_inverse=True)
    # Every stretch ends with symbol 0.
    ends = np.cumsum(kept.sizes + 1)
    begin = ends - kept.sizes - 1
    text = np.zeros(int(ends[-1]), np.int64)
    text[runs_of(begin, kept.sizes)] = symbols + 1
    index = FMIndex(text, len(vocabulary) + 1, LENGTH)
    places = runs_of(begin, kept.windows)
    unit = np.repeat(np.arange(len(kept)), kept.windows)
    which, low, high = index.intervals(places, least=2)
    owner = np.repeat(np.arange(len(kept)), kept.sizes + 1)
    least = least_within(kept.rank[owner][index.order], low, high)
    hit = which[least < kept.rank[unit[which]]]
    covered = np.zeros(len(places) + 1, np.bool_)
    covered[hit] = True
    # Runs of covered windows inside one stretch.
    same = np.zeros(len(places), np.bool_)
    same[1:] = unit[1:] == unit[:-1]
    inside = covered[:-1]
    opens = np.flatnonzero(inside & ~(same & np.concatenate([[False], inside[:-1]])))
    goes_on = np.append(same[1:], False) & covered[1:]
    closes = np.flatnonzero(inside & ~goes_on) + 1
    of = unit[opens]
    base = np.cumsum(kept.windows) - kept.windows
    run_low, run_high = opens - base[of], closes - base[of]
    # The runs of a content hold for all its units (texts of one document).
    edges = np.append(first, len(content))
    times = np.diff(edges)[of]
    rows = runs_of(edges[:-1][of], times)
    return units.cuts(np.repeat(run_low, times), np.repeat(run_high, times), rows)


def repeated_words(
    units: DataFrame, shard_words: int = SHARD_WORDS, waiting_rows: int = WAITING_ROWS
) -> DataFrame:
    """``(ta, tb, low, high)``: word ranges of texts that an earlier text has too. A shard is all of
    some anchors' units, ``shard_words`` words of them about; a task works on one after the other.
    """
    rows = units.repartition("key").sortWithinPartitions("key", "rank")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Units] = []
        fresh = 0
        for batch in batches:
            sent = np.asarray(batch.column("words").is_valid())
            if not sent.all():
                yield _finished(batch.filter(pa.array(~sent)))
                batch = batch.filter(pa.array(sent))
            if not batch.num_rows:
                continue
            waiting.append(Units.of(batch))
            last = waiting[-1].key[-1]
            fresh += batch.num_rows
            if fresh < waiting_rows:
                continue
            units, content, cuts = settle_equal(Units.joined(waiting))
            yield cuts
            # Rows of the last key may still come; the shards of the others are complete.
            whole = units.key != last
            if units.sizes[whole].sum() >= shard_words:
                yield repeated_intervals(units.take(np.flatnonzero(whole)), content[whole])
                units = units.take(np.flatnonzero(~whole))
            waiting, fresh = [units], 0
        if waiting:
            units, content, cuts = settle_equal(Units.joined(waiting))
            yield cuts
            yield repeated_intervals(units, content)

    return rows.mapInArrow(emit, "ta long, tb long, low int, high int")


def _finished(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The cuts of rows without words."""
    lists = batch.column("starts")
    times = lists.value_lengths().to_numpy().astype(np.int64)
    start = lists.flatten().to_numpy().astype(np.int64)
    ta, tb, windows = (np.repeat(batch.column(c).to_numpy(), times) for c in ("ta", "tb", "windows"))
    return _cut_rows(ta, tb, start, start + windows + LENGTH - 1)


def _text_ids() -> list:
    """Two hashes that together tell texts apart."""
    return [
        F.xxhash64("text").alias("ta"),
        F.xxhash64(F.lit(1), F.col("text")).alias("tb"),
    ]


def removed_words(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``(ta, tb, rank, cuts)`` of every distinct text that holds a window: its smallest document,
    and the ranges of words to remove from it there. In a later document the whole text repeats.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("rank"), *_text_ids(), "text").filter(
        F.col("rank").isNotNull() & (F.octet_length("text") >= LEAST_BYTES)
    )
    with dropped_shuffles(spark):
        common = common_keys(rows.select("text"), anchor_keys)
        shared = shared_anchors(rows.select("ta", "tb", "text"), common, crowded)
        ranks = rows.groupBy("ta", "tb").agg(F.min("rank").alias("rank"))
        texts = materialize(ranks.join(shared, ["ta", "tb"], "left"), "word-anchors")
        # Ids and ranks together spread copies of one text over all tasks.
        found = rows.join(texts, ["ta", "tb", "rank"])
        units = text_units(found.select("ta", "tb", "rank", "text", "anchors"), common)
        cuts = repeated_words(units).groupBy("ta", "tb")
        cuts = cuts.agg(F.collect_set(F.struct("low", "high")).alias("cuts"))
        return materialize(
            texts.select("ta", "tb", "rank").join(cuts, ["ta", "tb"], "left"), "word-cuts"
        )


SPANS = "array<struct<low:int,high:int>>"


def cut_words(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``n_words, n_removed, spans`` (maximal ranges of removed words) and ``kept``, the words that
    stay with one space between them as UTF-8 (null for a null text), of every document. The
    columns of ``docs`` other than ``text`` come as ``c0, c1, ...`` in their order, so that none
    of their names can clash.
    """
    ranges = removed_words(docs, crowded)
    others = [n for n in docs.columns if n != "text"]
    carried = [f"c{i}" for i in range(len(others))]
    rows = docs.select(
        *[F.col(n).alias(c) for n, c in zip(others, carried)],
        "text",
        *_text_ids(),
        F.col("doc_id").cast("long").alias("own"),
    ).join(ranges, ["ta", "tb"], "left")
    later = F.coalesce(F.col("own") > F.col("rank"), F.lit(False))
    first = F.coalesce(F.col("own") == F.col("rank"), F.lit(False))
    rows = rows.select(
        *carried, "text", later.alias("later"), F.when(first, F.col("cuts")).alias("cuts")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            offsets, data = text_bytes(texts)
            valid = texts.is_valid().to_pylist()
            later = batch.column("later").to_pylist()
            cuts = batch.column("cuts")
            found = cuts.is_valid().to_pylist()
            counts, removed, spans, kept = [], [], [], []
            for i in range(len(later)):
                # Bytes are split at exactly the six bytes of white space.
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                total = len(words)
                ranges = []
                if later[i]:
                    ranges = [(0, total)] if total >= LENGTH else []
                elif found[i]:
                    ranges = _merged([(r["low"], r["high"]) for r in cuts[i].as_py()])
                for low, high in reversed(ranges):
                    del words[low:high]
                counts.append(total)
                removed.append(total - len(words))
                spans.append([{"low": a, "high": b} for a, b in ranges])
                kept.append(b" ".join(words) if valid[i] else None)
            columns = [batch.column(n) for n in carried]
            columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            columns += [pa.array(spans, kind), pa.array(kept, pa.binary())]
            names = [*carried, "n_words", "n_removed", "spans", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried]
    schema = ", ".join([*fields, f"n_words long, n_removed long, spans {SPANS}, kept binary"])
    return rows.mapInArrow(emit, schema)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(r) for r in out]


def deduplicate_words(docs: DataFrame) -> DataFrame:
    """Words of every whole text that are covered by a 13-word window of an earlier document.

    Input: ``doc_id`` (whole numbers), ``text``; other columns are ignored. Output, one row per
    input row: ``doc_id, n_words, n_removed`` and ``kept_sha256`` of the words that stay, one space
    between them.

    Defined cases: null texts have no words; texts with fewer than 13 words lose nothing; a row
    with a null ``doc_id`` has no place in the order, so it loses nothing and takes nothing from
    others; rows of one ``doc_id`` are no earlier than each other; an empty table gives an empty
    result. Texts and stretches are told apart by 128-bit digests, words by 64-bit ones.
    """
    rows = cut_words(docs.select("doc_id", "text"))
    kept = F.coalesce(F.col("kept"), F.lit(b""))
    return rows.select(
        F.col("c0").alias("doc_id"), "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256")
    )
