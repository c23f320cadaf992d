"""Distributed tokenization of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokenize(df: DataFrame, tokenizer, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """Add the token ids of each document.

    Encoding is a map over Arrow batches wherever the rows already are. Order is not kept by
    arrival: it travels as columns (``pos`` or ``start``). A refused document has null ids.
    """
    return df.withColumn(tokens, tokenizer.encode(F.col(text)))
