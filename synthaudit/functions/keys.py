"""Seeded, partition-independent ordering of rows by key.

``md5(seed || '|' || key)`` gives the same order in Spark and in any SQL
engine, on any partitioning; ties (never in practice) fall back to the key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(seed, *parts) -> Column:
    """md5 hex of ``seed|part1|part2...``; parts are columns or literals."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces.append(F.lit("|"))
        pieces.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.md5(F.concat(*pieces))


def hash_rank_key(seed, key: Column) -> Column:
    """60-bit integer prefix of the md5 order key (orders like the hex text)."""
    return F.conv(F.substring(hash_text(seed, key), 1, 15), 16, 10).cast("long")
