"""Exact top-k inner products by multi-resolution segment statistics.

A vector is summarised at several resolutions: its components are cut into
1, 4, 16, ... segments and each segment keeps its mean and deviation.  Per
segment of length n the squared distance of two vectors is at least
n * ((mean difference)^2 + (deviation difference)^2).  As
2 q.x = |q|^2 + |x|^2 - distance^2, this lower bound of the distance bounds
the inner product from above by the sum of n * (mean*mean + dev*dev).  From
coarse to fine, pairs whose bound is below the query's k-th best score so far
are dropped; survivors get their exact integer inner product.

Queries are taken in blocks of at most about ``block`` vectors; one block is
broadcast at a time against all rows, each task keeps k rows per query, and a
block's result is written before the next one starts.  The vectors are never
shuffled.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; only vectors of equal length are compared; a query does not meet
rows of its own id; a repeated row is a candidate each time; ties go to the smaller
id; fewer than k candidates give fewer rows; an empty table gives none; null
ids take no part; other columns are ignored.  An inner product that does not fit
64 bits is an error, never a wrong score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthaudit.functions.shipping import ship_package
from synthaudit.llm.common import schema_of, scratch_table

SCALE = 256.0
_SLACK = 1e-9              # relative rounding allowance of the bounds, which are sums of floats


def quantise(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x.astype(np.float64))


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that the product of two
    rows is the upper bound of their inner product."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            root = math.sqrt(b - a)
            out += [x[:, a:b].mean(axis=1) * root, x[:, a:b].std(axis=1) * root]
    return np.stack(out, axis=1)


def resolutions(dim: int) -> list[int]:
    out, s = [], 1
    while s < dim:
        out.append(s)
        s *= 4
    return out


def _dot(a: np.ndarray, b: np.ndarray, pairs=None) -> np.ndarray:
    """Exact integer products: floats while every partial sum is below 2^53."""
    dim = a.shape[1]
    if dim == 0:
        return np.zeros((len(a), len(b)) if pairs is None else len(pairs[0]), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim >= 2.0 ** 53:
        a, b = (np.vectorize(int, otypes=[object])(v) for v in (a, b))     # Python's integers
    got = a @ b.T if pairs is None else (a[pairs[0]] * b[pairs[1]]).sum(axis=1)
    return got.astype(np.int64)


class Search:
    """The k best rows of each query of a block, over batches of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.levels = resolutions(vectors.shape[1])
        self.stats = [segment_statistics(vectors, s) for s in self.levels]
        self.norm = np.sqrt((vectors ** 2).sum(axis=1))
        self.floor = np.full(len(ids), -np.inf)            # the k-th best score so far
        self.best = (np.zeros(0, np.int64),) * 3           # query, id, score

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt((x ** 2).sum(axis=1))
        slack = _SLACK * (self.norm[:, None] * norm[None, :]) + 1e-6
        alive = self.ids[:, None] != ids[None, :]
        for s, own in zip(self.levels, self.stats):
            if not np.isfinite(self.floor).any():
                break                                      # nothing to compare a bound with yet
            theirs = segment_statistics(x, s)
            if alive.mean() > 0.1:
                alive &= own @ theirs.T + slack >= self.floor[:, None]
            else:
                a, b = np.nonzero(alive)
                alive[a, b] = np.einsum("ij,ij->i", own[a], theirs[b]) + slack[a, b] >= self.floor[a]
        if alive.mean() > 0.1:
            score = _dot(self.q, x)
            alive &= score >= self.floor[:, None]
            a, b = np.nonzero(alive)
            score = score[a, b]
        else:
            a, b = np.nonzero(alive)
            score = _dot(self.q, x, (a, b))
            on = score >= self.floor[a]
            a, b, score = a[on], b[on], score[on]
        query, cand, score = (np.concatenate(p) for p in zip(self.best, (a, ids[b], score)))
        order = np.lexsort((cand, -score, query))
        query, cand, score = query[order], cand[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.best = query[keep], cand[keep], score[keep]
        rank = (np.arange(len(query)) - first)[keep]
        full = rank == self.k - 1
        self.floor[self.best[0][full]] = self.best[2][full]


def _by_length(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors):
        a, b = groups.setdefault(len(v), ([], []))
        a.append(i)
        b.append(v)
    return {n: (np.array(a, np.int64), quantise(np.array(b, np.float64).reshape(len(a), n)))
            for n, (a, b) in groups.items()}


def _batch_groups(batch: pa.RecordBatch):
    ids, column = batch.column("vec_id"), batch.column("embedding")
    length = np.diff(column.offsets.to_numpy())
    if len(length) and (length == length[0]).all():
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(length), length[0])
        return {int(length[0]): (ids.to_numpy(zero_copy_only=False), quantise(flat))}
    return _by_length(ids.to_pylist(), column.to_pylist())


def _search_rows(shared, k: int):
    def run(batches):
        ids, vectors = shared.value
        searches = {n: Search(i, v, k) for n, (i, v) in _by_length(ids, vectors).items()}
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                for n, (cand, x) in _batch_groups(batch.slice(i, 1024)).items():
                    if n in searches:
                        searches[n].add(cand, x)
        for s in searches.values():
            q, c, score = s.best
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[q]), pa.array(c), pa.array(score)],
                                             names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for each
    row of ``vectors`` (``vec_id, embedding``) where ``is_query`` holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    queries = rows.where(is_query)
    n_blocks = max(1, math.ceil(queries.count() / block))
    found = None
    for n in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == n).distinct().collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in own], [list(r[1]) for r in own]))
        part = rows.mapInArrow(_search_rows(shared, k),
                               schema_of(("query_id", "long"), ("vec_id", "long"), ("score", "long")))
        if n_blocks > 1:
            part = scratch_table(part, "nearest")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
