"""Deterministic pseudo-random columns: the same on every engine, run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_order(seed: str, *keys: Column) -> Column:
    """A hexadecimal string that orders rows at random."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def md5_uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of the same string."""
    return (F.conv(F.substring(md5_order(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def md5_bucket(key: Column, buckets: int = 100) -> Column:
    """The whole md5 number modulo ``buckets``, folded from four 32-bit limbs."""
    digest, base = F.md5(key), (1 << 32) % buckets
    limb = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    out = limb(0) % buckets
    for k in (1, 2, 3):
        out = (out * base + limb(k)) % buckets
    return out.cast("int")
