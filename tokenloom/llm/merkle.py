"""Merkle manifest of a dataset, its nodes labelled by the leaf ranks that they cover.

Leaves are ranked inside their group; a node of level j covers an interval of ranks that begins at
a multiple of ``fanout ** j``. Levels are kept in buckets of ``LEVELS``: one row of a bucket holds
all nodes below one node of the bucket's top level, at most ``2 * fanout ** LEVELS`` of them. A row
finds its ancestors by a join with the next bucket on the interval that contains its own, one
row to one row, so a proof grows from the root downwards and no leaf is copied once per level. The
siblings of a node are the nodes of its level that tile its parent's interval less its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.session import broadcast_if_small, materialize

# Levels of one bucket: a row holds the nodes over so many levels below it.
LEVELS = 8
# Bits of a generated row number that count the rows of a partition.
ROW_BITS = 33
# Columns of a document's leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(text, 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row's values, each `-` if null, else its UTF-8 length, a colon and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(counted, F.lit("-")))
    return digest(F.concat(*parts))


def group_key(value: Column) -> Column:
    """A group's name as text that is never null; a null name sorts before all others."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``low``, the rank in ``grp`` by ``order``, and ``n``, the rows of ``grp``.

    Rows are sorted by range over all tasks, so a group of any size is spread; numbers count on
    inside a task, and one offset per task and group makes them ranks.
    """
    spread = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = materialize(spread.withColumn("_id", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_id", ROW_BITS))
    sizes = placed.groupBy("grp", "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
    )
    by_part = Window.partitionBy("grp").orderBy("_part")
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "grp",
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("grp")).alias("n"),
    )
    offsets = materialize(offsets, f"{name}-offsets")
    joined = placed.join(broadcast_if_small(offsets, offsets.count(), 100_000), ["grp", "_part"])
    rank = F.col("_before") + F.col("_id") - F.col("_first")
    return joined.select(*rows.columns, rank.alias("low"), "n")


def _parents(nodes: Column, fanout: int) -> Column:
    """Digests of every ``fanout`` consecutive nodes, the last run as long as it is."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(fanout)).cast("int"))
    run = lambda i: F.slice(nodes, i * F.lit(fanout) + 1, fanout)
    return F.transform(runs, lambda i: digest(F.array_join(run(i), "")))


def _levels(leaves: Column, n: Column, below: int, fanout: int) -> Column:
    """The bottom level and those above it, up to the group's root or the bucket's top.

    ``below`` is the number of ranks under one node of the bottom level. A group goes on while
    more than one node remains in the whole of it.
    """
    spans = F.array(*[F.lit(below * fanout**j).cast("long") for j in range(LEVELS)])
    return F.aggregate(
        spans,
        F.array(leaves),
        lambda known, span: F.when(
            n > span, F.concat(known, F.array(_parents(F.element_at(known, -1), fanout)))
        ).otherwise(known),
    )


def _siblings(levels: Column, place: Column, fanout: int) -> Column:
    """Per level below the top one, digests to the left and right of the node over bottom place
    ``place`` within its parent: the parent's interval of places less the node's own.
    """
    steps = F.slice(levels, F.lit(1), F.size(levels) - 1)

    def at(nodes: Column, level: Column) -> Column:
        width = F.element_at(F.array(*[F.lit(fanout**j) for j in range(LEVELS)]), level + 1)
        own_low = F.floor(place / width).cast("int")
        own_high = own_low + 1
        low = own_low - own_low % F.lit(fanout)
        high = low + F.lit(fanout)
        left = F.slice(nodes, low + 1, own_low - low)
        right = F.slice(nodes, own_high + 1, high - own_high)
        return F.struct(
            F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")
        )

    return F.transform(steps, at)


def _build(members: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Stage tables of all buckets, lowest first: ``(grp, n, low, high, members, levels)``.

    ``members`` is ``(grp, n, low, digest, ...)``, what follows being carried by the lowest bucket.
    """
    largest = members.agg(F.max("n")).first()[0] or 0
    buckets: list[DataFrame] = []
    cells, below, span = members, 1, fanout**LEVELS
    while True:
        held = [c for c in cells.columns if c not in ("grp", "n")]
        top = below * span
        block = (F.floor(F.col("low") / F.lit(top)) * top).cast("long")
        rows = cells.withColumn("_low", block).groupBy("grp", "n", "_low")
        rows = rows.agg(F.sort_array(F.collect_list(F.struct(*held))).alias("members"))
        nodes = F.transform("members", lambda m: m["digest"])
        rows = rows.select(
            "grp",
            "n",
            F.col("_low").alias("low"),
            F.least(F.col("_low") + top, F.col("n")).alias("high"),
            "members",
            _levels(nodes, F.col("n"), below, fanout).alias("levels"),
        )
        rows = materialize(rows, f"{name}-{len(buckets)}")
        buckets.append(rows)
        if largest <= top:
            return buckets
        head = F.element_at(F.element_at("levels", -1), 1)
        cells = rows.filter(F.col("n") > top).select("grp", "n", "low", head.alias("digest"))
        below = top


def _tops(buckets: list[DataFrame], fanout: int) -> DataFrame:
    """``(grp, digest)``: the root of every group, from the bucket in which it ends."""
    found = None
    for k, rows in enumerate(buckets):
        ended = (F.col("n") <= fanout ** (LEVELS * (k + 1))) & (
            F.col("n") > (fanout ** (LEVELS * k) if k else 0)
        )
        root = F.element_at(F.element_at("levels", -1), 1).alias("digest")
        part = rows.filter(ended).select("grp", root)
        found = part if found is None else found.unionByName(part)
    return found


def _attach(buckets: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The lowest bucket's rows with ``path`` (siblings from their top node to the root) and
    ``top`` and ``root``. ``above`` is ``(grp, top, root, path)`` of every group's root.
    """
    upper = None
    for k in reversed(range(len(buckets))):
        rows, span = buckets[k], fanout ** (LEVELS * (k + 1))
        ended = rows.filter(F.col("n") <= span).join(above, "grp")
        if upper is None:
            upper = ended
            continue
        # Bucketed containment: the one row of the next bucket whose interval covers this one's.
        cell = (F.floor(F.col("low") / F.lit(span * fanout**LEVELS))).cast("long")
        inner = rows.filter(F.col("n") > span).withColumn("_cell", cell)
        outer = upper.select(
            "grp",
            cell.alias("_cell"),
            F.col("low").alias("_low"),
            F.col("high").alias("_high"),
            F.col("levels").alias("_levels"),
            F.col("path").alias("_path"),
            "top",
            "root",
        )
        met = inner.join(outer, ["grp", "_cell"]).filter("_low <= low and high <= _high")
        place = F.floor((F.col("low") - F.col("_low")) / F.lit(span))
        path = F.concat(_siblings(F.col("_levels"), place, fanout), F.col("_path"))
        upper = ended.unionByName(met.select(*rows.columns, "top", "root", path.alias("path")))
    return upper


@dataclass(frozen=True)
class Manifest:
    """Stage tables of the groups' trees and of the tree over their roots."""

    groups: list[DataFrame]
    roots: list[DataFrame]
    payload: tuple[str, ...]
    fanout: int

    def nodes(self) -> DataFrame:
        """``(grp, level, low, high, digest)`` of every node; the tree over the groups' roots has
        a null ``grp``, and its ranks are those of the groups.
        """
        found = None
        for buckets in (self.groups, self.roots):
            for k, rows in enumerate(buckets):
                # The top level of a bucket is the bottom level of the next one.
                kept = F.when(
                    F.col("n") > self.fanout ** (LEVELS * (k + 1)),
                    F.slice("levels", 1, LEVELS),
                ).otherwise(F.col("levels"))
                name = F.col("grp") if buckets is self.groups else F.lit(None).cast("string")
                part = rows.select(
                    name.alias("grp"), "n", "low", F.posexplode(kept).alias("_j", "_nodes")
                )
                part = part.select(
                    "grp", "n", "low", "_j", F.posexplode("_nodes").alias("_i", "digest")
                )
                width = F.pow(F.lit(self.fanout), F.col("_j") + LEVELS * k).cast("long")
                low = F.col("low") + F.col("_i") * width
                part = part.select(
                    "grp",
                    (F.col("_j") + LEVELS * k).alias("level"),
                    low.alias("low"),
                    F.least(low + width, F.col("n")).alias("high"),
                    "digest",
                )
                found = part if found is None else found.unionByName(part)
        return found

    def root(self) -> str | None:
        """The root's digest; none of an empty dataset."""
        row = _tops(self.roots, self.fanout).first()
        return row["digest"] if row else None

    def proofs(self) -> DataFrame:
        """``(payload..., leaf, top, root, path)`` of every leaf: its group's root, the whole
        root, and the siblings ``(left, right)`` level by level up to it.
        """
        whole = _tops(self.roots, self.fanout).select("grp", F.col("digest").alias("root"))
        empty = F.array().cast("array<struct<left:string,right:string>>")
        whole = whole.select("grp", F.lit("").alias("top"), "root", empty.alias("path"))
        above = _attach(self.roots, whole, self.fanout)
        above = self._members(above, ["name", "digest"]).select(
            F.col("name").alias("grp"), F.col("digest").alias("top"), "root", "path"
        )
        leaves = _attach(self.groups, above, self.fanout)
        return self._members(leaves, [*self.payload, "digest"], "top").select(
            *self.payload, F.col("digest").alias("leaf"), "top", "root", "path"
        )

    def _members(self, rows: DataFrame, names: Sequence[str], *held: str) -> DataFrame:
        """One row per member of the lowest bucket, its siblings inside the row put before the
        row's path. All is made inside the row, so that no member carries the row's nodes.
        """
        path = lambda m: F.concat(
            _siblings(F.col("levels"), m["low"] - F.col("low"), self.fanout), F.col("path")
        )
        member = lambda m: F.struct(
            *[m[n].alias(n) for n in names], path(m).alias("path")
        )
        return rows.select(
            *held, "root", F.inline(F.transform("members", member))
        )


def manifest(leaves: DataFrame, fanout: int = 2) -> Manifest:
    """Trees over ``leaves``: ``(grp, doc_id, digest, ...)``, other columns carried to the proofs.

    Leaves of a group (a text, see ``group_key``) ascend by ``doc_id``, nulls first, and of one
    ``doc_id`` by digest and the carried columns. While more than one node remains, every
    ``fanout`` consecutive ones become the digest of their digests, a last shorter run too. The
    groups' roots, in order of their names, are the leaves of one more such tree.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least two")
    payload = tuple(c for c in leaves.columns if c not in ("grp", "digest"))
    others = [c for c in payload if c != "doc_id"]
    stored = materialize(leaves, "merkle-leaves")
    members = ranked(stored, ["doc_id", "digest", *others], "merkle-ranks")
    groups = _build(members, fanout, "merkle-groups")
    tops = _tops(groups, fanout).select(
        F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"
    )
    roots = _build(ranked(tops, ["name"], "merkle-names"), fanout, "merkle-roots")
    return Manifest(groups, roots, payload, fanout)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        path, leaf, lambda node, side: digest(F.concat(side["left"], node, side["right"]))
    )


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    sides = F.transform(path, lambda side: F.concat(side["left"], side["right"]))
    return digest(F.array_join(sides, ""))


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and a check of every document against it, after one in seven
    (those whose crc32 of the decimal ``doc_id`` seven divides) got one more in ``n_chars``.

    Input: ``doc_id, source, lang, n_chars, text``; other columns are ignored. Output, one row per
    input row: ``doc_id, leaf, subroot, root, proof_sha256`` of the table as it came,
    ``folded_root`` from the changed leaf and the stored siblings, and ``verified``.

    Defined cases: null values have their own mark in a leaf, and a null ``n_chars`` stays null; a
    null ``lang`` is a group of its own, before all others; a null ``doc_id`` comes first and is
    never changed; rows of one ``doc_id`` go by their digests, equal rows are equal leaves; an empty
    table gives an empty result.
    """
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = F.coalesce(number % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    plain = {c: F.col(c) for c in LEAF_COLUMNS}
    other = {**plain, "n_chars": F.col("n_chars") + 1}
    leaves = docs.select(
        group_key(F.col("lang")).alias("grp"),
        "doc_id",
        leaf_digest(list(plain.values())).alias("digest"),
        F.when(changed, leaf_digest(list(other.values()))).alias("changed"),
    )
    proofs = manifest(leaves).proofs()
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    return proofs.select(
        "doc_id",
        "leaf",
        F.col("top").alias("subroot"),
        "root",
        path_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
