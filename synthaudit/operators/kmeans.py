"""Partition-independent k-means (Lloyd) as DataFrame aggregates.

Start: k-means++ on at most ``init_sample`` rows taken in seeded hash order
(the same rows on any partitioning), seeded numpy RNG on the driver (only
the ≤ k·p centre numbers and the bounded sample live there).  Each round
labels every row with its nearest centre by a column expression over the
literal centres and recomputes centres with ``groupBy(label).avg`` (partial
aggregation; a hot cluster costs no more than a cold one).  Stops when no
centre moves more than ``tol`` or after ``max_iter`` rounds (``fit_report``
says which).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthaudit.operators.sampling import first_n


def sq_dist_expr(cols: list[str], centre) -> Column:
    total = None
    for c, m in zip(cols, centre):
        d = F.col(c) - F.lit(float(m))
        total = d * d if total is None else total + d * d
    return total


def nearest_label_expr(cols: list[str], centres: np.ndarray) -> Column:
    """Index of the nearest centre (lowest index on ties)."""
    if len(centres) == 1:
        return F.lit(0)
    cands = [F.struct(sq_dist_expr(cols, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.least(*cands)["i"]


def _kmeanspp(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    n = len(x)
    centres = [x[rng.integers(n)]]
    d2 = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        tot = d2.sum()
        if tot <= 0:
            centres.append(x[rng.integers(n)])
        else:
            centres.append(x[rng.choice(n, p=d2 / tot)])
        d2 = np.minimum(d2, ((x - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _lloyd_local(x: np.ndarray, centres: np.ndarray, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    for _ in range(max_iter):
        d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        lab = d.argmin(axis=1)
        new = centres.copy()
        for j in range(len(centres)):
            sel = x[lab == j]
            if len(sel):
                new[j] = sel.mean(axis=0)
        shift = float(np.max(np.abs(new - centres)))
        centres = new
        if shift < tol:
            break
    return centres


MAX_ITER, TOL = 20, 1e-4       # defaults of every fit


def fit(*args, **settings) -> np.ndarray:
    """The k×p centre array of ``fit_report``."""
    return fit_report(*args, **settings)[0]


def fit_report(df: DataFrame, key: str, cols: list[str], k: int, seed: int = 42, max_iter: int = MAX_ITER,
               tol: float = TOL, init_sample: int = 10_000, n_rows: int | None = None,
               start: np.ndarray | None = None) -> tuple[np.ndarray, int, bool]:
    """Return the k×p centre array, the rounds over all rows and whether the
    last one converged.  Lloyd first converges on the seeded sample (bounded,
    on the driver), then refines on all rows.  Given ``start`` centres take
    the place of the sample; rounds then end early only if no centre moves."""
    if start is not None:
        centres, limit = np.array(start, dtype="float64"), 0.0
    else:
        sample = first_n(df.select(key, *cols), key, init_sample, seed, n_rows).toPandas()
        x = sample.sort_values(key)[cols].to_numpy(dtype="float64")
        rng = np.random.default_rng(seed)
        k = max(1, min(k, len(x)))
        centres = _lloyd_local(x, _kmeanspp(x, k, rng))
        # convergence as the common k-means convention: total squared centre
        # shift below tol × mean column variance
        limit = tol * float(np.mean(np.var(x, axis=0))) if len(x) else 0.0
    rounds, converged = 0, False
    while rounds < max_iter and not converged:
        lab = nearest_label_expr(cols, centres)
        rows = (df.select(lab.alias("__c"), *cols).groupBy("__c")
                .agg(*[F.avg(c).alias(c) for c in cols]).collect())
        new = centres.copy()
        for r in rows:
            new[int(r["__c"])] = [r[c] for c in cols]
        shift = float(np.sum((new - centres) ** 2))
        centres, rounds, converged = new, rounds + 1, shift <= limit
    return centres, rounds, converged


def assign(df: DataFrame, cols: list[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, nearest_label_expr(cols, centres))
