"""Exact nearest-neighbour search of a bounded query set against a table.

Used by linkability (Gower, two column halves at once), CMLA calibration
and medoid distances (Euclidean).  The query set is bounded by the number
of attacks, a parameter, so it travels inside the task closure, in blocks of
``MAX_QUERIES`` rows; the candidate table is scanned once a block in Arrow
batches by ``mapInPandas``, in chunks of ``MAX_CELLS`` distances, so a task's
memory does not depend on the table.  Each task
emits one row per query with its partial arg-min, and a small ``groupBy``
over ``|queries| × tasks`` rows picks the winner.  No pair of rows is ever
materialised as a Spark row, and nothing but the winners leaves a task.

Ties go to the lowest candidate key.  Distances are sums in column order
of plain IEEE operations, so the same numbers come out of SQL engines.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from synthaudit.functions.shipping import ship_package

MAX_QUERIES = 20_000       # query rows shipped to tasks at once
MAX_CELLS = 500_000        # distance-matrix cells held at once per task: a few matrices of 4 MB
_BIG = np.iinfo(np.int64).max


@dataclass(frozen=True, eq=False)
class ColSpec:
    column: str
    kind: str              # "num": |a-b|/scale (Gower); "cat": mismatch; "sq": (a-b)^2
    scale: object = 1.0    # float, or one value per query row (array)


@dataclass(frozen=True)
class Metric:
    name: str
    cols: tuple            # tuple[ColSpec]
    root: bool = False     # sqrt of the sum (Euclidean)


def _num_gower(q, c, scale):
    sc = np.broadcast_to(np.asarray(scale, dtype="float64"), q.shape)
    d = np.subtract(q[:, None], c[None, :])
    np.abs(d, out=d)
    zero = sc == 0
    with np.errstate(invalid="ignore", divide="ignore"):
        d /= np.where(zero, 1.0, sc)[:, None]
    if zero.any():
        d[zero, :] = 0.0
    qn, cn = np.flatnonzero(np.isnan(q)), np.flatnonzero(np.isnan(c))
    d[qn, :] = 1.0                                # NULL rules, in place
    d[:, cn] = 1.0
    d[np.ix_(qn, cn)] = 0.0
    return d


def _cat_codes(values, vocab):
    """Code of each value in ``vocab`` (-1 unknown, -2 NULL), vectorised."""
    cats = list(vocab)
    codes = pd.Categorical(pd.Series(values, dtype=object), categories=cats).codes.astype(np.int64)
    nulls = pd.isna(pd.Series(values, dtype=object)).to_numpy()
    return np.where(nulls, -2, codes)


def _candidate_columns(cpdf: pd.DataFrame, metrics: list[Metric], vocabs: dict) -> dict:
    """Each (column, is text) of a batch as codes or doubles, once for all its chunks."""
    out = {}
    for s in (s for m in metrics for s in m.cols):
        cat = s.kind == "cat"
        if (s.column, cat) not in out:
            out[s.column, cat] = _cat_codes(cpdf[s.column].tolist(), vocabs[s.column]) if cat else pd.to_numeric(
                cpdf[s.column], errors="coerce").to_numpy(dtype="float64", na_value=np.nan)
    return out


def _distances(metric: Metric, qdata: dict, cdata: dict, rows: slice):
    total = None
    for s in metric.cols:
        q, c = qdata[s.column], cdata[s.column, s.kind == "cat"][rows]
        if s.kind == "cat":
            d = q[:, None] != c[None, :]
        elif s.kind == "num":
            d = _num_gower(q, c, s.scale)
        else:  # "sq"
            d = np.subtract(q[:, None], c[None, :])
            np.multiply(d, d, out=d)
        if total is None:
            total = d.astype("float64", copy=False)
        else:
            total += d                              # same left-to-right order as SQL
    return np.sqrt(total, out=total) if metric.root else total


def _metric_of(metric: Metric, rows: slice) -> Metric:
    """The metric for some of the query rows (a scale may hold one value per row)."""
    return replace(metric, cols=tuple(replace(s, scale=np.asarray(s.scale)[rows]) if np.ndim(s.scale) else s
                                      for s in metric.cols))


def nearest(cands: DataFrame, key: str, queries: pd.DataFrame, qkey: str, metrics: list[Metric],
            exclude_self: bool = False) -> DataFrame:
    """For every query row the nearest candidate per metric.

    Returns ``(q_key, <metric>_dist, <metric>_key ...)``; with
    ``exclude_self`` a candidate with the query's own key is skipped.
    """
    if len(queries) > MAX_QUERIES:
        blocks = [slice(i, i + MAX_QUERIES) for i in range(0, len(queries), MAX_QUERIES)]
        return reduce(DataFrame.unionByName, [
            nearest(cands, key, queries.iloc[b], qkey, [_metric_of(m, b) for m in metrics], exclude_self)
            for b in blocks])
    spark = cands.sparkSession
    ship_package(spark)
    if len(queries) == 0:
        fields = ", ".join(f"{m.name}_dist double, {m.name}_key long" for m in metrics)
        return spark.createDataFrame([], f"q_key long, {fields}")
    cols = sorted({s.column for m in metrics for s in m.cols})
    qkeys = queries[qkey].to_numpy(dtype="int64")
    qdata, vocabs = {}, {}
    for m in metrics:
        for s in m.cols:
            if s.kind == "cat":
                vals = queries[s.column].tolist()
                vocab = {}
                for v in vals:
                    if v is not None and v not in vocab:
                        vocab[v] = len(vocab)
                vocabs[s.column] = vocab
                qdata[s.column] = _cat_codes(vals, vocab)
            else:
                qdata[s.column] = queries[s.column].to_numpy(dtype="float64", na_value=np.nan)
    nq = len(qkeys)

    def part(batches):
        best = {m.name: (np.full(nq, np.inf), np.full(nq, _BIG, dtype=np.int64)) for m in metrics}
        seen = False
        step = max(1, MAX_CELLS // max(1, nq))
        rows = np.arange(nq)
        for pdf in batches:
            seen = seen or len(pdf) > 0
            # sorted by key, the first minimum of a row is the lowest key among ties
            pdf = pdf.sort_values(key, kind="stable")
            keys, cdata = pdf[key].to_numpy(dtype="int64"), _candidate_columns(pdf, metrics, vocabs)
            for i in range(0, len(pdf), step):
                chunk = slice(i, i + step)
                ck = keys[chunk]
                for m in metrics:
                    d = _distances(m, qdata, cdata, chunk)
                    if exclude_self:
                        own = np.flatnonzero(np.isin(ck, qkeys))
                        row, at = np.nonzero(qkeys[:, None] == ck[own][None, :])
                        d[row, own[at]] = np.inf
                    idx = d.argmin(axis=1)
                    dmin = d[rows, idx]
                    kmin = np.where(np.isfinite(dmin), ck[idx], _BIG)
                    bd, bk = best[m.name]
                    better = (dmin < bd) | ((dmin == bd) & (kmin < bk))
                    best[m.name] = (np.where(better, dmin, bd), np.where(better, kmin, bk))
        if not seen:
            return
        out = {"q_key": qkeys}
        for m in metrics:
            bd, bk = best[m.name]
            out[f"{m.name}_dist"] = bd
            out[f"{m.name}_key"] = bk
        yield pd.DataFrame(out)

    fields = ", ".join(f"{m.name}_dist double, {m.name}_key long" for m in metrics)
    partial = cands.select(key, *cols).mapInPandas(part, f"q_key long, {fields}")
    aggs = [F.min(F.struct(F.col(f"{m.name}_dist").alias("d"), F.col(f"{m.name}_key").alias("k")))
            .alias(m.name) for m in metrics]
    red = partial.groupBy("q_key").agg(*aggs)
    sel = [F.col("q_key")]
    for m in metrics:
        # no finite candidate (e.g. only self) -> NULL
        sel += [F.when(F.col(f"{m.name}.k") != F.lit(_BIG), F.col(f"{m.name}.d")).alias(f"{m.name}_dist"),
                F.when(F.col(f"{m.name}.k") != F.lit(_BIG), F.col(f"{m.name}.k")).alias(f"{m.name}_key")]
    return red.select(*sel)
