"""Exact values at given ranks, of many columns at once.

A double's bits, with the sign folded in, order like the number.  A first pass
counts the rows of each column by the leading 16 bits of that key; running
sums say in which bin each wanted rank lies, and the next pass counts only the
rows of these bins, by 8 more bits, or by all of them once they hold few rows.
A pass is one scan with a partial count in each task; only the wanted bins
(one for each rank) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package

FIRST_SHIFT, STEP = 48, 8
FEW_ROWS = 2_000_000        # rows in wanted bins that are counted by their whole key
_TOP = np.uint64(1 << 63)


def order_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned keys that order like ``x`` (NaN last, zeros alike)."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def key_values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & _TOP, keys & ~_TOP, ~keys).view(np.float64)


def _count(batches: Iterator[pa.RecordBatch], wanted: list | None, before: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Rows by column and bin (key without its last ``shift`` bits) of the
    ``wanted`` bins (without the last ``before`` bits), None: of all rows."""
    total: dict = {}
    for batch in batches:
        for j, column in enumerate(batch.columns):
            keys = order_keys(column.drop_null().to_numpy(zero_copy_only=False))
            if wanted is not None:
                at = np.searchsorted(wanted[j], keys >> np.uint64(before))
                keys = keys[(at < len(wanted[j])) & (np.append(wanted[j], np.uint64(0))[at] == keys >> np.uint64(before))]
            bins, n = np.unique(keys >> np.uint64(shift), return_counts=True)
            if j in total:
                bins, which = np.unique(np.concatenate([total[j][0], bins]), return_inverse=True)
                n = np.bincount(which, np.concatenate([total[j][1], n]), len(bins)).astype(np.int64)
            total[j] = bins, n
    for j, (bins, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), j)), pa.array(bins.view(np.int64)), pa.array(n)],
                                         names=["column", "bin", "n"])


def values_at_ranks(df: DataFrame, columns: list[str], ranks: list[list[int]]) -> list[np.ndarray]:
    """For each column, its values at the given ranks (from 0, among its
    non-null values in order)."""
    spark = df.sparkSession
    ship_package(spark)
    doubles = df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"c{j}") for j, c in enumerate(columns)])
    out = [np.zeros(len(r)) for r in ranks]
    # (column, bin, rank inside the bin, position in the answer)
    open_ranks = [(j, 0, r, k) for j, rs in enumerate(ranks) for k, r in enumerate(rs)]
    wanted, before, shift = None, 64, FIRST_SHIFT
    while open_ranks:
        counts = doubles.mapInArrow(lambda it, w=wanted, b=before, s=shift: _count(it, w, b, s), "column long, bin long, n long")
        counts = counts.groupBy("column", "bin").agg(F.sum("n").alias("n"))
        parent = F.lit(0).cast("long") if wanted is None else F.shiftrightunsigned("bin", before - shift)
        order = Window.partitionBy("column", "parent").orderBy(F.shiftrightunsigned("bin", 1), "bin")
        upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("parent", parent).withColumn("upto", upto)
        asked = spark.createDataFrame(open_ranks, "column long, parent long, rank long, place long")
        found = (counts.join(F.broadcast(asked), ["column", "parent"])
                 .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
                 .select("column", "bin", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "place", "n").collect())
        if shift == 0:
            for r in found:
                out[r["column"]][r["place"]] = key_values(np.array([r["bin"]], np.int64).view(np.uint64))[0]
            break
        open_ranks = [(r["column"], r["bin"], r["rank"], r["place"]) for r in found]
        inside = sum({(r["column"], r["bin"]): r["n"] for r in found}.values())
        wanted = [np.unique(np.array([r["bin"] for r in found if r["column"] == j], np.int64)).astype(np.uint64)
                  for j in range(len(columns))]
        before, shift = shift, 0 if inside <= FEW_ROWS else max(0, shift - STEP)
    return out


def knot_ranks(n: int, knots: int) -> list[int]:
    """Ranks of the ``knots`` evenly spaced quantiles of ``n`` values (the
    smallest value that at least this share of the values does not exceed)."""
    return [max(0, math.ceil((j / (knots - 1.0)) * n) - 1) for j in range(knots)]
