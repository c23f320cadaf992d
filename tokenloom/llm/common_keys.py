"""Very common keys, found in a bounded sample of texts.

A key that many texts hold is known to be shared before anything is shuffled; such keys are kept
out of the shuffles that look for shared keys. The list only moves work: any list gives the same
results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.batches import text_parts

# Bounds of the sample (distinct texts, about) and of the list; and the texts of the sample that
# must hold a key.
SAMPLE_TEXTS, MAX_KEYS, MIN_TEXTS = 4096, 100_000, 8


def common_keys(texts: DataFrame, keys: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """At most ``MAX_KEYS`` keys, the most common first. ``texts`` is ``(text)``; ``keys`` gives
    the distinct 64-bit keys of each text of a batch.
    """
    rows = texts.count()
    share = max(1, rows // SAMPLE_TEXTS)
    digest = F.xxhash64("text")
    sample = texts.filter(F.pmod(digest, F.lit(share)) == 0).dropDuplicates(["text"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches):
            found = [np.empty(0, np.uint64), *keys(batch.column(0))]
            column = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([column], ["k"])

    counted = sample.mapInArrow(emit, "k long").groupBy("k").count()
    counted = counted.filter(F.col("count") >= MIN_TEXTS)
    top = counted.orderBy(F.desc("count"), "k").limit(MAX_KEYS).toArrow()
    return top.column("k").to_numpy().view(np.uint64)
