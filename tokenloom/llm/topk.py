"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are rotated onto the principal axes of a sample, so that few coordinates carry most of an
inner product. Vectors are stored and scanned by descending length, in blocks. A block whose longest
vector cannot reach a query's worst kept score is passed over. Otherwise the first coordinates are
multiplied, and by Cauchy-Schwarz the rest adds at most the product of the residual lengths; only
pairs that may still reach the worst kept score are multiplied out, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenloom.session import materialize, ship_package

SCALE = 1024
# Vectors per block, longest vectors that set first bounds, sample of the rotation, and queries
# sent to the tasks at once: the driver holds one such block, of this many rows and bytes at most.
BLOCK_ROWS, SEEDS, SAMPLE_ROWS, QUERY_ROWS = 2048, 2048, 4096, 8192
QUERY_BYTES = 32 << 20
# Share of the coordinates in the first partial sum.
HEAD = 4
PAIRS_AT_ONCE = 1 << 18


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part: an id, and a vector of finite numbers."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Queries:
    """A block of queries and the best scores that each has met."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.rotation = rotation
        self.turned = matrix @ rotation
        self.length = np.linalg.norm(self.turned, axis=1)
        self.head = max(1, matrix.shape[1] // HEAD)
        self.rest = np.linalg.norm(self.turned[:, self.head :], axis=1)
        self.bound = np.full(len(ids), -np.inf)
        empty = np.empty(0, np.int64)
        self.kept = (empty, empty, empty)  # query, vector, score

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """Scan a block of vectors."""
        turned = matrix @ self.rotation
        length = np.linalg.norm(turned, axis=1)
        # Rounding of the rotated sums stays far below this.
        slack = 1 + 1e-9 * self.length * (length.max() if len(length) else 0)
        reach = self.length * (length.max() if len(length) else 0) + slack
        able = np.flatnonzero(reach >= self.bound)
        if not len(able):
            return
        rest = np.linalg.norm(turned[:, self.head :], axis=1)
        step = max(1, PAIRS_AT_ONCE // max(1, len(ids)))
        for low in range(0, len(able), step):
            q = able[low : low + step]
            most = self.turned[q, : self.head] @ turned[:, : self.head].T
            most += np.outer(self.rest[q], rest)
            most += slack[q, None]
            query, vector = np.nonzero(most >= self.bound[q, None])
            query = q[query]
            other = self.ids[query] != ids[vector]
            self._add(query[other], ids, matrix, vector[other])

    def least_norm(self) -> float:
        """Squared length below which no vector reaches the worst kept score of any query."""
        if not len(self.ids) or not (self.bound > 0).all():
            return 0.0
        # The scores are at most the product of the lengths; the margin covers their rounding.
        return float(np.min(self.bound / self.length)) ** 2 * (1 - 1e-6)

    def _add(self, query, ids, matrix, vector) -> None:
        for low in range(0, len(query), PAIRS_AT_ONCE):
            a, b = query[low : low + PAIRS_AT_ONCE], vector[low : low + PAIRS_AT_ONCE]
            score = np.einsum("ij,ij->i", self.matrix[a], matrix[b])
            good = score >= self.bound[a]
            self._keep(a[good], ids[b[good]], score[good])

    def _keep(self, query, vector, score) -> None:
        query = np.concatenate([self.kept[0], query])
        vector = np.concatenate([self.kept[1], vector])
        score = np.concatenate([self.kept[2], score])
        order = np.lexsort((vector, -score, query))
        query, vector, score = query[order], vector[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        last = rank == self.k - 1
        self.bound[query[last]] = np.maximum(self.bound[query[last]], score[last])
        best = rank < self.k
        self.kept = (query[best], vector[best], score[best])


def rotation_of(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of a bounded sample, the heaviest first; any rotation gives right results."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
    matrix = _matrix(sample.column("v").combine_chunks(), width).astype(np.float64)
    scale = max(1.0, float(np.abs(matrix).max()) if matrix.size else 1.0)
    _, axes = np.linalg.eigh((matrix / scale).T @ (matrix / scale))
    return np.ascontiguousarray(axes[:, ::-1])


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """The ``k`` best scores of each query: the rows whose ``vec_id`` is divisible by ``every``.

    Input: ``vec_id``, ``embedding`` (list of numbers); other columns are ignored. A component x
    counts as floor(scale * x); the score is the inner product of the whole numbers. Output:
    ``query_id, rank`` (from 1), ``vec_id, score``; ties go to the smaller ``vec_id``.

    Defined cases: rows without an id, and vectors that are null or hold a null or non-finite
    number, take no part; a shorter vector counts as ending in zeros; rows that share the query's
    id are its own; repeated rows are candidates, and queries, once each; with fewer candidates
    all are returned; an empty table gives an empty result. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    whole = whole_vectors(vectors, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = whole.withColumn("norm", norm)
    # Descending length, across partitions and inside them.
    ordered = whole.repartitionByRange(F.desc("norm")).sortWithinPartitions(F.desc("norm"), "vec_id")
    stored = materialize(ordered, "vectors")
    is_query = F.col("vec_id") % every == 0
    facts = stored.agg(
        F.max(F.size("v")).alias("width"), F.count(F.when(is_query, 1)).alias("queries")
    ).first()
    width = facts["width"] or 0
    rows = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, width))))
    parts = -(-facts["queries"] // rows)
    schema = "query_id long, q long, vec_id long, score long"
    if not width or not parts:
        found = [spark.createDataFrame([], schema)]
    else:
        rotation = rotation_of(stored, width)
        seeds = stored.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
        # One block at a time: fetched, searched and written before the next is fetched.
        found = []
        for part in range(parts):
            one = _search(stored, part, parts, every, width, rotation, seeds, k)
            found.append(materialize(one, "top-k") if parts > 1 else one)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")


def _search(stored, part, parts, every, width, rotation, seeds, k) -> DataFrame:
    """Candidates of one block of queries, at most ``k`` of each query from a task."""
    # Over the vector too, so that rows which repeat an id spread over the blocks.
    mine = F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)) == part
    asked = stored.filter((F.col("vec_id") % every == 0) & mine).select("vec_id", "v").toArrow()
    ids = asked.column("vec_id").to_numpy()
    matrix = _matrix(asked.column("v").combine_chunks(), width)
    order = np.lexsort((*matrix.T[::-1], ids))
    ids, matrix = ids[order], matrix[order]
    first = Queries(ids, matrix, rotation, k)
    if seeds.num_rows:
        first.meet(
            seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v").combine_chunks(), width)
        )
    bound = first.bound

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(ids, matrix, rotation, k)
        queries.bound = bound.copy()
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(low, BLOCK_ROWS)
                queries.meet(rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), width))
        q, vector, score = queries.kept
        columns = [pa.array(ids[q]), pa.array((part << 32) + q), pa.array(vector), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "vec_id", "score"])

    # Stored by descending length, so the statistics of row groups pass over the tail.
    rows = stored.filter(F.col("norm") >= first.least_norm()).select("vec_id", "v")
    return rows.mapInArrow(emit, "query_id long, q long, vec_id long, score long")
