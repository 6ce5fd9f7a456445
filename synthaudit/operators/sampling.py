"""Seeded sampling and splitting (T1–T4, T9) without a global sort.

Order of rows = ``(md5(seed|key), key)``.  ``first_n`` keeps the first n
rows of that order.  For small n it is a top-k (each task keeps n rows).
For large n (the train/control cut) the n-th row is found by histograms
of the hash's leading bits: one aggregate gives at most 4,096 bucket
counts, the bucket holding the cut is refined the same way until it is
small, and only that bucket is ranked.  The result is a plain filter
``(h, key) <= (h*, key*)`` — no shuffle of the table and no single-task
window over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from synthaudit.functions.keys import hash_rank_key

TOPK_LIMIT = 10_000          # up to this many rows: top-k
BUCKET_BITS = 12            # 4,096 buckets per histogram level
FINAL_BUCKET_ROWS = 200_000  # rank inside a bucket once it is this small


def with_hash_order(df: DataFrame, key: str, seed: int = 42, name: str = "__h") -> DataFrame:
    return df.withColumn(name, hash_rank_key(seed, F.col(key)))


def _kth_threshold(dfh: DataFrame, key: str, k):
    """(h*, key*) of the k-th row (1-based) in (__h, key) order, or None.
    ``k`` may be a function of the row count (known after the first
    histogram, so the split needs no separate count)."""
    sub = dfh.select("__h", key)
    shift = 60
    for level in range(4):
        shift -= BUCKET_BITS
        b = F.shiftright("__h", shift)
        hist = sub.groupBy(b.alias("__b")).agg(F.count(F.lit(1)).alias("n")).orderBy("__b").collect()
        if level == 0 and callable(k):
            k = k(sum(r["n"] for r in hist))
            if k <= 0:
                return None
        total = 0
        chosen = None
        for row in hist:
            if total + row["n"] >= k:
                chosen = row
                break
            total += row["n"]
        if chosen is None:
            return None
        k -= total
        sub = sub.where(b == chosen["__b"])
        if chosen["n"] <= FINAL_BUCKET_ROWS:
            break
    w = Window.orderBy("__h", key)
    row = sub.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == k).first()
    return (row["__h"], row[key])


def _before_or_at(h, kv, key: str):
    return (F.col("__h") < F.lit(h)) | ((F.col("__h") == F.lit(h)) & (F.col(key) <= F.lit(kv)))


SMALL_TABLE = 1_000_000     # below this many rows a plain top-k is cheapest


def first_n(df: DataFrame, key: str, n: int, seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows in seeded hash order (all rows if fewer).

    A top-k at the root of a plan sends every task's n best rows to the
    driver.  On a large table the rows are first restricted to a hash prefix
    expected to hold ~4n rows (the 60-bit hash is uniform): a filter with no
    shuffle; if fewer than n rows pass, the prefix is widened — exact."""
    dfh = with_hash_order(df, key, seed)
    if n <= TOPK_LIMIT:
        n_rows = n_rows if n_rows is not None else df.count()
        if n >= n_rows:
            return df
        if n_rows <= SMALL_TABLE:
            return dfh.orderBy("__h", key).limit(n).drop("__h")
        frac = min(1.0, (4.0 * n + 64.0) / n_rows)
        while frac < 1.0:
            pre = dfh.where(F.col("__h") < F.lit(int(frac * (1 << 60))))
            if pre.count() >= n:
                return pre.orderBy("__h", key).limit(n).drop("__h")
            frac = min(1.0, frac * 4.0)
        return dfh.orderBy("__h", key).limit(n).drop("__h")
    t = _kth_threshold(dfh, key, n)
    if t is None:
        return df
    return dfh.where(_before_or_at(t[0], t[1], key)).drop("__h")


def sample_n(df: DataFrame, key: str, n: int | None, seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """Cap to ``n`` rows if larger; ``None``/0 = no cap (decision D12)."""
    if not n:
        return df
    return first_n(df, key, n, seed, n_rows)


def train_control_split(df: DataFrame, key: str, ratio: float = 0.5, seed: int = 42,
                        n_rows: int | None = None):
    """Hash-shuffle and cut at ``floor(n·ratio)``: (train, control)."""
    import math

    dfh = with_hash_order(df, key, seed)
    t = _kth_threshold(dfh, key, lambda n: int(math.floor(n * ratio)))
    if t is None:
        return df.limit(0), df
    h, kv = t
    inside = _before_or_at(h, kv, key)
    return dfh.where(inside).drop("__h"), dfh.where(~inside).drop("__h")


def attack_cap(n_attacks: int, *counts: int) -> int:
    """``min(n_attacks, rows(real), rows(control), rows(syn))``."""
    return int(min([n_attacks, *counts]))
