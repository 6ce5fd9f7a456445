"""Seeded uniforms per (column, row id), computed JVM-side.

``u = (first 52 bits of md5(seed|stream|id) + 0.5) / 2^52`` — the same
numbers for a row on any partitioning, so sampled tables are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from synthaudit.functions.keys import hash_text


def hash_uniform(seed, stream: str | Column, row_id: Column) -> Column:
    bits = F.conv(F.substring(hash_text(seed, stream, row_id), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2 ** 52)
