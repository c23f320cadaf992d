"""Exact n-gram Jaccard join of whole texts with signature trees.

Equal shingle sets are one class and are joined once. Sets of two classes can only reach the
threshold when they share a token among the first ``n - ceil(t n) + 1`` of each, in any fixed order
of all tokens; here very common tokens come last. Classes that share such a token form a group, and
groups of the same members are joined once. Inside a group a signature tree prunes pairs, and
pairs that are connected already are not compared, so a cluster of copies costs its size, not its
square. A first walk with sizes and bitmaps alone finds the classes that may have a partner in a
group; only their sets travel. Each of those classes joins its largest group, with its set travelling
once; the walk is repeated with what is connected by then, so that few classes stay possible
partners. After that round the few sets that are left are told apart by wider bitmaps, and
what still may be similar is joined in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.llm.batches import binary_rows, text_parts
from tokenloom.llm.common_keys import common_keys
from tokenloom.llm.graph import components
from tokenloom.llm.shingles import set_digest, shingle_sets
from tokenloom.llm.shuffles import Stage, dropped_shuffles
from tokenloom.llm.signature_tree import Group, bitmap, bits_for, with_partner
from tokenloom.session import materialize, ship_package

# Jaccard threshold in percent.
PERCENT = 80
# Rounds in which a set joins its largest group only.
ROUNDS = 1
# Rows of a batch that are Python objects at once.
PART_ROWS = 256
# Bits for each token in the bitmaps of the last walk.
WIDE = 16
# Sets of a group that meet in one task; a larger group is cut into blocks that meet pair by pair.
BLOCK_SETS = 1024


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate([np.empty(0, np.uint64), *parts])
    return pa.LargeListArray.from_arrays(pa.array(edges.astype(np.int64)), _longs(flat)).cast(
        pa.list_(pa.int64())
    )


def text_sets(docs: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """``(doc_id, text_hash, set_id, n, rare, usual, bits)`` of every text: the set's digest (null
    when it is empty), its size, its first tokens, those outside and inside the common list, and
    its bitmap.
    """
    rank_of = np.argsort(common)
    sorted_common = common[rank_of]

    def first_tokens(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(tokens) - -(-percent * len(tokens) // 100) + 1
        if not len(common):
            return tokens[:size], tokens[:0]
        at = np.minimum(np.searchsorted(sorted_common, tokens), len(common) - 1)
        usual = sorted_common[at] == tokens
        rare = tokens[~usual]
        if len(rare) >= size:
            return rare[:size], tokens[:0]
        # The rarer of the common tokens come first: high ranks of the list.
        usual = tokens[usual][np.argsort(-rank_of[at[usual]], kind="stable")]
        return rare, usual[: size - len(rare)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches):
            ids, sizes, rare, usual, bits = [], [], [], [], []
            for tokens in shingle_sets(batch.column("text")):
                sizes.append(len(tokens))
                ids.append(set_digest(tokens) if len(tokens) else None)
                few, many = first_tokens(tokens) if len(tokens) else (tokens, tokens)
                rare.append(few)
                usual.append(many)
                own = bitmap(tokens, bits_for(len(tokens))).tobytes() if len(tokens) else None
                bits.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    _lists(rare),
                    _lists(usual),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "text_hash", "set_id", "n", "rare", "usual", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = (
        f"doc_id {kind}, text_hash long, set_id long, n long, "
        "rare array<long>, usual array<long>, bits binary"
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(emit, fields)


def groups_of(classes: DataFrame, stage: Stage) -> DataFrame:
    """``(group_id, set_id, members)`` of the groups of two and more classes, one group for each
    distinct set of members.
    """
    rare = classes.select("set_id", F.explode("rare").alias("group_id"))
    over = Window.partitionBy("group_id")
    rare = rare.withColumn("c", F.count(F.lit(1)).over(over)).filter(F.col("c") > 1)
    usual = classes.select("set_id", F.explode("usual").alias("group_id"))
    shared = stage(rare.select("group_id", "set_id").unionByName(usual), "shared-tokens")
    return stage(distinct_groups(shared), "groups")


def distinct_groups(rows: DataFrame) -> DataFrame:
    """Of the groups of two and more in ``(group_id, set_id)``, one for each distinct set of
    members, told by count, sum and digest of the members; adds ``members``, their count.
    """
    by_group = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.expr("bit_xor(xxhash64(set_id))").alias("x"),
        F.sum(F.expr("pmod(xxhash64(set_id, 1), 1099511627776)")).alias("y"),
    )
    chosen = by_group.filter("members > 1").groupBy("members", "x", "y")
    chosen = chosen.agg(F.min("group_id").alias("group_id"))
    return rows.join(chosen.select("group_id", "members"), "group_id")


def met(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of one group next to each other in one task, sorted by ``group_id, pair, set_id``. A
    group of more than ``BLOCK_SETS`` members is cut into blocks, and every ``pair`` of blocks
    meets.
    """
    parts = F.ceil(F.col("members") / F.lit(BLOCK_SETS)).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own"))
    pairs = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        # The pair of blocks (i, j), i < j, as one number; the block meets every other once.
        F.transform(
            others,
            lambda i: F.least(i, F.col("own")) * F.col("parts") + F.greatest(i, F.col("own")),
        )
    )
    rows = rows.withColumn("parts", parts).withColumn("own", own)
    rows = rows.withColumn("pair", F.explode(pairs))
    rows = rows.select("group_id", "pair", "set_id", *columns)
    return rows.repartition("group_id", "pair").sortWithinPartitions("group_id", "pair", "set_id")


def _groups(
    batches: Iterator[pa.RecordBatch], *columns: str
) -> Iterator[tuple[int, list[int], list[list]]]:
    """(group, set ids, columns) of the groups of two and more in a sorted task."""
    at, ids, values = None, [], [[] for _ in columns]
    parts = (b.slice(low, PART_ROWS) for b in batches for low in range(0, b.num_rows, PART_ROWS))
    for part in parts:
        found = [part.column(c).to_pylist() for c in ("group_id", "pair", "set_id", *columns)]
        for group, pair, set_id, *row in zip(*found):
            if (group, pair) != at:
                if len(ids) > 1:
                    yield at[0], ids, values
                at, ids, values = (group, pair), [], [[] for _ in columns]
            if ids and ids[-1] == set_id:
                continue
            ids.append(set_id)
            for column, value in zip(values, row):
                column.append(value)
    if len(ids) > 1:
        yield at[0], ids, values


def _pairs(rows: list[tuple[int, int]], first: str, second: str) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64())], [first, second]
    )


def possible(
    groups: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, stage: Stage
) -> DataFrame:
    """``(group_id, set_id, members)`` of the classes that may have a partner in the group that they
    are not connected to, by sizes and bitmaps; ``members`` counts those of a group. ``labels`` is
    ``(set_id, known)``; a class without one is connected to none.
    """
    known = classes.select("set_id", "n", "bits").join(labels, "set_id", "left")
    known = known.withColumn("known", F.coalesce("known", "set_id"))
    rows = met(groups.join(known, "set_id"), "n", "bits", "known")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group, ids, (sizes, bits, known) in _groups(batches, "n", "bits", "known"):
            maps = [np.frombuffer(b, np.uint64) for b in bits]
            kept = with_partner(np.array(sizes), maps, np.array(known), percent)
            out += [(group, ids[i]) for i in np.flatnonzero(kept)]
            if len(out) > 10_000:
                yield _pairs(out, "group_id", "set_id")
                out = []
        yield _pairs(out, "group_id", "set_id")

    rows = rows.mapInArrow(emit, "group_id long, set_id long").distinct()
    rows = stage(rows, "possible")
    return stage(distinct_groups(rows), "possible-groups")


def join_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Join the sets of each group: ``rows`` is ``(group_id, set_id, known, members, tokens)``,
    where sets of one ``known`` are connected already. Returns ``(a, b)``: for every set that a
    task connects to others, its ``known`` and the least ``known`` of its component there.
    """
    rows = met(rows, "known", "tokens")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: set[tuple[int, int]] = set()
        for _, ids, (known, tokens) in _groups(batches, "known", "tokens"):
            sets = [np.frombuffer(t, np.uint64) for t in tokens]
            group = Group(sets, np.array(known), percent)
            if group.join():
                labels = np.array(known)[group.order]
                for root in np.unique(group.root):
                    own = labels[group.root == root]
                    links |= {(int(a), int(own.min())) for a in own}
            if len(links) > 10_000:
                yield _pairs(list(links), "a", "b")
                links = set()
        yield _pairs(list(links), "a", "b")

    return rows.mapInArrow(emit, "a long, b long").filter("a != b")


def _key(doc_id: str) -> Column:
    """A join key that finds null ids too."""
    return F.xxhash64(F.lit("id"), doc_id)


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the ``tokens`` of each class, made anew from one text: ``wanted`` is
    ``(set_id, doc_id, text_hash)`` and any other numbers, which are carried along.
    """
    carried = [c for c in wanted.columns if c not in ("doc_id", "text_hash")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches):
            sets = list(shingle_sets(batch.column("text")))
            lengths = np.array([8 * len(s) for s in sets], np.int64)
            cells = binary_rows(lengths, np.concatenate([np.empty(0, np.uint64), *sets]))
            columns = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, cells], [*carried, "tokens"])

    rows = docs.select(_key("doc_id").alias("k"), F.xxhash64("text").alias("text_hash"), "text")
    keys = wanted.select(*carried, _key("doc_id").alias("k"), "text_hash")
    # Both keys are spread over all tasks: copies of one text have different ids.
    rows = rows.join(keys, ["k", "text_hash"]).select(*carried, "text")
    fields = [f"{c} {wanted.schema[c].dataType.simpleString()}" for c in carried]
    return rows.mapInArrow(emit, ", ".join([*fields, "tokens binary"]))


def wide_bitmaps(sets: DataFrame) -> DataFrame:
    """``(set_id, n, bits)`` of sets, with bitmaps that leave little doubt."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            sizes = pa.array([len(t) for t in found], pa.int64())
            maps = [bitmap(t, bits_for(len(t), WIDE)).tobytes() for t in found]
            bits = pa.array(maps, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), sizes, bits], ["set_id", "n", "bits"]
            )

    return sets.mapInArrow(emit, "set_id long, n long, bits binary")


def connected(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after links between their ``known``."""
    more = components(links).select(F.col("node").alias("known"), "label")
    moved = labels.join(more, "known", "left")
    moved = moved.select("set_id", F.coalesce("label", "known").alias("known"))
    return materialize(moved, "labels")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups of texts linked by a Jaccard similarity of at least ``percent``.

    Input: ``doc_id``, ``text``; other columns are ignored. Letters A-Z count as a-z, words are
    runs of bytes other than space and tab to carriage return, a set is the distinct five-word
    shingles of the whole text, or the whole sequence of a shorter one. Output, one row per input
    row: ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by links).

    Defined cases: null and wordless texts have an empty set, link with nothing and are their own
    component; rows that repeat a ``doc_id`` are joined by their own texts; a null ``doc_id`` is
    passed over when the smallest is taken, and a component of null ids alone has a null id;
    an empty table gives an empty result. Sets are told apart by 64-bit digests.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select("doc_id", "text")
    with dropped_shuffles(spark) as stage:
        common = common_keys(docs.filter("text is not null").select("text"), shingle_sets)
        texts = stage(text_sets(docs, common, percent), "text-sets")
        filled = texts.filter("set_id is not null")
        # One text stands for each class, that of the smallest id; null ids, which Spark puts first,
        # come last here. The copies leave each task at most once.
        no_id = F.col("doc_id").isNull().alias("no_id")
        classes = filled.groupBy("set_id").agg(
            F.min(F.struct(no_id, "doc_id", "text_hash")).alias("text"),
            F.first("rare").alias("rare"),
            F.first("usual").alias("usual"),
            F.first("n").alias("n"),
            F.first("bits").alias("bits"),
        )
        classes = stage(classes, "classes")
        labels = materialize(classes.select("set_id", F.col("set_id").alias("known")), "labels")
        groups = possible(groups_of(classes, stage), classes, labels, percent, stage)
        place = classes.select("set_id", "text.doc_id", "text.text_hash")
        for _ in range(ROUNDS):
            # Each class goes to its largest group, its set travels once.
            largest = F.max_by("group_id", F.struct("members", "group_id"))
            first = groups.groupBy("set_id").agg(largest.alias("group_id"))
            first = materialize(first, "largest-groups")
            sizes = first.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
            first = first.join(sizes.filter("members > 1"), "group_id").join(labels, "set_id")
            rows = class_sets(docs, first.join(place, "set_id"))
            labels = connected(labels, join_groups(rows, percent))
            groups = groups.select("group_id", "set_id", "members")
            groups = possible(groups, classes, labels, percent, stage)
        # What may still have a partner, in all its groups.
        members = groups.select("set_id").distinct()
        sets = stage(class_sets(docs, place.join(members, "set_id")), "sets")
        groups = possible(groups, wide_bitmaps(sets), labels, percent, stage)
        rows = groups.join(labels, "set_id").join(sets, "set_id")
        labels = connected(labels, join_groups(rows, percent))
        ids = classes.select("set_id", "text.doc_id").join(labels, "set_id")
        least = ids.groupBy("known").agg(F.min("doc_id").alias("component_id"))
        ids = materialize(ids.join(least, "known").select("set_id", "component_id"), "components")
        rows = materialize(texts.select("doc_id", "n", "set_id"), "set-ids")
    found = rows.join(ids, "set_id", "left")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the one with the smallest ``doc_id``; all columns are kept.

    Rows without a ``doc_id`` stay, and so do all rows that share the smallest one.
    """
    found = jaccard_components(docs, percent)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
