"""Text coercion and UTF-8 repair, built from the column's type at plan time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repair_utf8(value: Column) -> Column:
    """Bytes to text; every malformed sequence becomes U+FFFD."""
    return F.make_valid_utf8(value.cast("string"))


def is_malformed_utf8(value: Column) -> Column:
    """True where the bytes are not valid UTF-8."""
    return ~F.is_valid_utf8(value.cast("string"))


def coerce_to_text(value: Column, dtype: T.DataType) -> Column:
    """Any column to text: text and bytes are read as UTF-8 with replacement (text files may hold
    broken bytes too), arrays are coerced item by item and joined with one space (empty items
    dropped, null when none is left), anything else takes Spark's string form. Null stays null.
    """
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return repair_utf8(value)
    if isinstance(dtype, T.ArrayType):
        texts = F.transform(value, lambda item: coerce_to_text(item, dtype.elementType))
        kept = F.filter(texts, lambda item: F.length(item) > 0)
        return F.nullif(F.array_join(kept, " "), F.lit(""))
    return value.cast("string")


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The coerced text of ``df``; null when the input has no such column."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return coerce_to_text(df[name], df.schema[name].dataType)


def has_malformed(value: Column, dtype: T.DataType) -> Column:
    """Whether any text or bytes of a column of this type are not valid UTF-8."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(is_malformed_utf8(value), F.lit(False))
    if isinstance(dtype, T.ArrayType):
        inner = F.exists(value, lambda item: has_malformed(item, dtype.elementType))
        return F.coalesce(inner, F.lit(False))
    return F.lit(False)


def malformed_column(df: DataFrame, name: str = "text") -> Column:
    """Whether the text of ``df`` needed repair; false when the input has no such column."""
    if name not in df.columns:
        return F.lit(False)
    return has_malformed(df[name], df.schema[name].dataType)


def utf8_length(text: Column) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(text)
