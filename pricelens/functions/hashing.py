"""Partition-independent hash buckets (same rows on any cluster layout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_bucket(key, seed: int, buckets: int = 100) -> Column:
    """``int(md5(seed|key)[:8], 16) % buckets``.

    Depends only on the key, never on row order or partitioning, so a split
    is identical after repartitioning, on retry, and in any SQL engine that
    has md5.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")
