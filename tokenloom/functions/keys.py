"""Keys and draws that depend only on row values, so that retries and repartitioning repeat them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int, *identity: str) -> Column:
    """Hex key of a row under ``seed``; hex text sorts like the unsigned number it spells."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))


def key_bucket(key: Column, buckets: int) -> Column:
    """Even split of hex keys into ``buckets`` ranges; never decreases as the key grows."""
    if not 1 <= buckets <= 1 << 30:
        raise ValueError("buckets must be between 1 and 2^30")
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.shiftright(head * F.lit(buckets).cast("long"), 32).cast("int")


def keyed_draw(bound: int | Column, *parts: Column) -> Column:
    """A repeatable draw from ``[0, bound)`` named by ``parts`` (60 bits of an md5)."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return F.pmod(number, F.lit(bound).cast("long") if isinstance(bound, int) else bound)


def keyed_uniform(*parts: Column) -> Column:
    """A repeatable uniform in ``[0, 1)`` named by ``parts`` (48 bits of an md5)."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return number / F.lit(float(1 << 48))
