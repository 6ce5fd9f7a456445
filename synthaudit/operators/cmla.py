"""Cluster-medoid leakage attack (P3; J1–J3, G9–G12).

1. Numeric columns, NULL → 0, z-score with the real mean and population
   std (zero std → 1); the same transform is applied to syn.
2. Clusters of real rows: a given label column, or k-means (k ≤ n−1).
3. Medoid per cluster: the real row nearest its centroid (lowest key on
   ties) — two aggregates over a broadcast of the ≤ k centroids.
4. Threshold: the p-th percentile of the distances from a seeded sample of
   ≤ 500 real rows to their nearest *other* real row (decision D1;
   ``calibration="literal"`` keeps the row itself, distance 0).
5. Risk: share of syn rows whose nearest medoid is closer than the
   threshold; CI = ±0.02 clipped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.functions.columns import numeric_columns
from synthaudit.functions.parallel import run_parallel
from synthaudit.functions.shipping import ship_package
from synthaudit.operators import kmeans
from synthaudit.operators.nearest import ColSpec, Metric, nearest
from synthaudit.operators.results import AttackResult, failed_result
from synthaudit.operators.sampling import first_n
from synthaudit.operators.stats import zero_filled_profile, zscore
from synthaudit.session import cut_lineage

MAX_CLUSTERS = 1_000   # up to here centroids are broadcast and medoids are literals of a column expression


def scaled(real: DataFrame, syn: DataFrame, key: str, cols: list[str] | None = None):
    cols = cols or numeric_columns(real, key)
    prof = zero_filled_profile(real, cols)
    return zscore(real, prof, cols, key), zscore(syn, prof, cols, key), cols


def euclid_expr(cols: list[str], other: dict) -> F.Column:
    total = None
    for c in cols:
        d = F.col(c) - other[c]
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def centroids(zreal: DataFrame, cols: list[str], label: str = "cluster") -> DataFrame:
    """Mean of every scaled column per cluster."""
    return zreal.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols])


def _nearest_of_task(batches, key: str, label: str):
    """Per cluster the task's row of the smallest (dist, key)."""
    best = None
    for pdf in batches:
        best = pdf if best is None else pd.concat([best, pdf])
        best = best.sort_values(["dist", key], kind="stable").drop_duplicates(label)
    if best is not None:
        yield best


def medoids(zreal: DataFrame, key: str, cols: list[str], label: str = "cluster") -> DataFrame:
    """Per cluster the row nearest the centroid (``cluster, key, dist``),
    in two scans: one for the centroids, one in which every task keeps its
    nearest row of each cluster."""
    cent = cut_lineage(centroids(zreal, cols, label))
    few = cent.count() <= MAX_CLUSTERS
    small = F.broadcast if few else (lambda df: df)      # more: Spark chooses the join
    c = small(cent.select(label, *[F.col(x).alias(f"__c_{x}") for x in cols]))
    d = zreal.join(c, label).select(label, key, euclid_expr(cols, {x: F.col(f"__c_{x}") for x in cols}).alias("dist"))
    if few:
        ship_package(zreal.sparkSession)
        d = d.mapInPandas(lambda it: _nearest_of_task(it, key, label), d.schema)      # at most MAX_CLUSTERS rows a task
    best = d.groupBy(label).agg(F.min(F.struct("dist", key)).alias("best"))
    return best.select(label, F.col(f"best.{key}").alias(key), F.col("best.dist").alias("dist"))


def calibration_distances(zreal: DataFrame, key: str, cols: list[str], n_probes: int = 500,
                          seed: int = 42, calibration: str = "nearest_other", n_rows: int | None = None) -> DataFrame:
    """``(probe_key, dist)`` nearest real row for a seeded probe sample."""
    probes = first_n(zreal, key, n_probes, seed, n_rows).toPandas()
    m = Metric("e", tuple(ColSpec(c, "sq") for c in cols), root=True)
    nn = nearest(zreal, key, probes, key, [m], exclude_self=(calibration != "literal"))
    return nn.select(F.col("q_key").alias("probe_key"), F.col("e_dist").alias("dist"))


def medoid_distances(zsyn: DataFrame, key: str, cols: list[str], med_rows: list) -> DataFrame:
    """Distance of every syn row to its nearest medoid, no shuffle."""
    if len(med_rows) > MAX_CLUSTERS:
        return _many_medoid_distances(zsyn, key, cols, np.array([[r[c] for c in cols] for r in med_rows], float))
    ds = [euclid_expr(cols, {c: F.lit(float(r[c])) for c in cols}) for r in med_rows]
    dmin = ds[0] if len(ds) == 1 else F.least(*ds)
    return zsyn.select(key, dmin.alias("dist"))


def _many_medoid_distances(zsyn: DataFrame, key: str, cols: list[str], med: np.ndarray) -> DataFrame:
    """As above for medoids too many for an expression: blocks of them in numpy."""
    ship_package(zsyn.sparkSession)

    def part(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64")
            best = np.full(len(x), np.inf)
            for i in range(0, len(med), 256):
                block = med[i:i + 256]
                d = np.zeros((len(x), len(block)))
                for j in range(len(cols)):
                    d += (x[:, j, None] - block[None, :, j]) ** 2
                np.minimum(best, d.min(axis=1), out=best)
            yield pd.DataFrame({key: pdf[key], "dist": np.sqrt(best)})

    schema = T.StructType([zsyn.schema[key], T.StructField("dist", T.DoubleType())])
    return zsyn.select(key, *cols).mapInPandas(part, schema)


@dataclass
class CmlaReference:
    """Real-side part of CMLA, shared by every candidate model."""
    cols: list
    profile: object
    medoid_rows: list
    threshold: float
    k: int
    calibration: str
    distance_percentile: float
    scaled_real: DataFrame
    medoids: DataFrame
    calibration_distances: DataFrame
    cached: list = None          # frames persisted by the fit (released by the caller)
    remark: str = ""             # end of the notes: k-means that did not converge


def fit_reference(real: DataFrame, key: str, n_clusters: int = 10, distance_percentile: float = 5.0,
                  labels: str | None = None, calibration: str = "nearest_other", n_probes: int = 500,
                  seed: int = 42, kmeans_max_iter: int = kmeans.MAX_ITER,
                  kmeans_tol: float = kmeans.TOL) -> CmlaReference:
    cols = numeric_columns(real, key)
    if not cols:
        raise ValueError("No numeric columns found.")
    prof = zero_filled_profile(real, cols)
    # read by every Lloyd round and the calibration; given labels come along
    zr = zscore(real, prof, cols, key, carry={"cluster": labels} if labels is not None else None).persist()
    cached = [zr]

    def clusters():
        if labels is not None:
            z, remark = zr, ""
            kk = z.select("cluster").distinct().count()
        else:
            kk = max(1, min(n_clusters, prof.n_rows - 1))
            cent, rounds, converged = kmeans.fit_report(zr, key, cols, kk, seed, kmeans_max_iter, kmeans_tol,
                                                        n_rows=prof.n_rows)
            z = kmeans.assign(zr, cols, cent)
            remark = "" if converged else f" | k-means not converged in {rounds} rounds"
        m = medoids(z, key, cols)
        # a row per cluster meets the table: broadcast, so that the table stays where it is
        few = F.broadcast(m) if kk <= MAX_CLUSTERS else m
        rows = z.select(key, *cols).join(few, key).orderBy("cluster").collect()
        return z, kk, m, rows, remark

    def calibrate():
        # independent of the clusters: runs alongside k-means
        c = calibration_distances(zr, key, cols, n_probes, seed, calibration, prof.n_rows)
        return c, c.agg(F.percentile("dist", distance_percentile / 100.0)).first()[0]

    res = run_parallel({"clusters": clusters, "cal": calibrate})
    zr, k, med, med_rows, remark = res["clusters"]
    cal, t = res["cal"]
    return CmlaReference(cols, prof, med_rows, float(t) if t is not None else 0.0, k, calibration,
                         distance_percentile, zr, med, cal, cached, remark)


def score(ref: CmlaReference, syn: DataFrame, key: str, detail: bool = False):
    missing = [c for c in ref.cols if c not in syn.columns]
    if missing:
        return failed_result("CMLA", f"synthetic table lacks {missing}")
    zs = zscore(syn, ref.profile, ref.cols, key)
    dist = medoid_distances(zs, key, ref.cols, ref.medoid_rows)
    r = dist.agg(F.count_if(F.col("dist") < F.lit(ref.threshold)).alias("leak"),
                 F.count(F.lit(1)).alias("n")).first()
    n_leak, n_syn = int(r["leak"]), int(r["n"])
    asr = n_leak / n_syn if n_syn else 0.0
    if detail:
        return {"scaled_real": ref.scaled_real, "scaled_syn": zs, "medoids": ref.medoids,
                "calibration": ref.calibration_distances, "threshold": ref.threshold, "distances": dist,
                "n_leaking": n_leak, "n_syn": n_syn, "k": ref.k}
    return AttackResult(
        "CMLA", asr, max(0.0, asr - 0.02), min(1.0, asr + 0.02), n_syn, False,
        f"k={ref.k} | threshold={ref.threshold:.4f} (p{ref.distance_percentile:.0f} real-real, "
        f"{ref.calibration}) | leaking={n_leak}/{n_syn}{ref.remark}", n_leak, None)


def cmla(real: DataFrame, syn: DataFrame, key: str, n_clusters: int = 10, distance_percentile: float = 5.0,
         labels: str | None = None, calibration: str = "nearest_other", n_probes: int = 500,
         seed: int = 42, detail: bool = False):
    """P3. ``labels`` names a cluster column of ``real`` to use instead of
    k-means.  Returns an AttackResult (or a dict of intermediate frames
    with ``detail``)."""
    try:
        cols = numeric_columns(real, key)
        if not cols:
            return failed_result("CMLA", "No numeric columns found.")
        missing = [c for c in cols if c not in syn.columns]
        if missing:
            return failed_result("CMLA", f"synthetic table lacks {missing}")
        ref = fit_reference(real, key, n_clusters, distance_percentile, labels, calibration, n_probes, seed)
        return score(ref, syn, key, detail)
    except Exception as exc:  # noqa: BLE001 - fail safe, whatever stops the attack
        return failed_result("CMLA", str(exc))
