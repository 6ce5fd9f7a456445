"""Linkability attack.

The attacker knows half A of a target's columns and, separately, half B
(first ``n_aux`` columns / the rest).  For each target the nearest
synthetic row by Gower distance on A and on B is found; the target is
linked when both are the same row.  Targets: the first ``n_attacks``
training rows in seeded hash order (attack) and as many control rows
(baseline).  Gower per column: numeric ``|a−b|/range`` with the range over
syn ∪ targets (0 when the range is 0); categorical mismatch 0/1; one side
NULL → 1; both NULL → 0.  Summed in column order; ties → lowest key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.columns import feature_columns, is_numeric_type
from synthaudit.functions.risk import residual_risk
from synthaudit.operators.nearest import ColSpec, Metric, nearest
from synthaudit.operators.results import AttackResult, failed_result
from synthaudit.operators.sampling import first_n


def halves(cols: list[str], n_aux_cols: int | None = None):
    """The two disjoint column halves."""
    n = n_aux_cols or max(1, len(cols) // 2)
    return cols[:n], cols[n:]


def target_rows(df: DataFrame, key: str, cols: list[str], n_attacks: int, seed: int = 42,
                n_rows: int | None = None):
    """The attack sample (≤ n_attacks rows, seeded hash order) as pandas."""
    return first_n(df.select(key, *cols), key, n_attacks, seed, n_rows).toPandas()


def _ranges(tp, nums, syn_bounds) -> dict:
    ranges = {}
    for c in nums:
        lo, hi = syn_bounds[c]
        tv = tp[c].astype("float64")
        vals = [v for v in (lo, hi, tv.min(skipna=True), tv.max(skipna=True)) if v is not None and v == v]
        ranges[c] = (max(vals) - min(vals)) if vals else 0.0
    return ranges


def _syn_bounds(syn: DataFrame, nums: list[str]) -> dict:
    if not nums:
        return {}
    b = syn.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(nums)],
                *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(nums)]).first()
    return {c: (b[f"lo{i}"], b[f"hi{i}"]) for i, c in enumerate(nums)}


def links_many(target_sets: dict, syn: DataFrame, key: str, cols_a: list[str], cols_b: list[str]) -> DataFrame:
    """Links of several target samples in ONE scan of syn.  Each set keeps
    its own Gower ranges (syn ∪ that set), carried per query row.
    Returns ``(target_set, target_key, nn_key_a, nn_key_b, linked)``."""
    import numpy as np
    import pandas as pd

    cols = cols_a + cols_b
    nums = [c for c in cols if is_numeric_type(syn.schema[c].dataType)]
    bounds = _syn_bounds(syn, nums)
    frames, scales = [], {c: [] for c in nums}
    for name, tp in target_sets.items():
        tp = tp[[key] + cols].copy()
        rg = _ranges(tp, nums, bounds)
        for c in nums:
            scales[c].append(np.full(len(tp), rg[c]))
        # query ids must be unique across sets: (set index, position)
        tp["__set"] = name
        frames.append(tp)
    q = pd.concat(frames, ignore_index=True)
    q["__qid"] = np.arange(len(q), dtype="int64")
    sc = {c: np.concatenate(v) if v else np.array([]) for c, v in scales.items()}

    def spec(c):
        return ColSpec(c, "num", sc[c]) if c in sc else ColSpec(c, "cat")

    metrics = [Metric("a", tuple(spec(c) for c in cols_a)), Metric("b", tuple(spec(c) for c in cols_b))]
    nn = nearest(syn, key, q, "__qid", metrics)
    ids = syn.sparkSession.createDataFrame(q[["__qid", "__set", key]].rename(
        columns={"__qid": "q_key", "__set": "target_set", key: "target_key"}))
    # ids: one row per target; Spark knows the size of these local rows
    return nn.join(ids, "q_key").select(
        "target_set", "target_key", F.col("a_key").alias("nn_key_a"), F.col("b_key").alias("nn_key_b"),
        (F.col("a_key") == F.col("b_key")).alias("linked"))


def linkability(real: DataFrame, syn: DataFrame, control: DataFrame, key: str,
                n_attacks: int = 500, n_aux_cols: int | None = None, seed: int = 42,
                detail: bool = False):
    """Linkability risk of ``syn`` (returns AttackResult, or the
    per-target link rows when ``detail``)."""
    cols = feature_columns(real, key)
    a, b = halves(cols, n_aux_cols)
    if not a or not b:
        return failed_result("Linkability", "need at least two columns for two halves")
    missing = [c for c in cols if c not in syn.columns]
    if missing:
        return failed_result("Linkability", f"synthetic table lacks {missing}")
    tr = target_rows(real, key, cols, n_attacks, seed)
    tc = target_rows(control, key, cols, n_attacks, seed)
    return link_risk(tr, tc, syn, key, a, b, detail)


def link_risk(tr, tc, syn: DataFrame, key: str, a: list[str], b: list[str], detail: bool = False):
    """Risk from prepared target samples (shared across candidate models)."""
    if not a or not b:
        return failed_result("Linkability", "need at least two columns for two halves")
    missing = [c for c in a + b if c not in syn.columns]
    if missing:
        return failed_result("Linkability", f"synthetic table lacks {missing}")
    both = links_many({"train": tr, "control": tc}, syn, key, a, b)
    if detail:
        return both
    n, nc = len(tr), len(tc)
    counts = {r["target_set"]: r["k"] for r in both.where("linked").groupBy("target_set")
              .agg(F.count(F.lit(1)).alias("k")).collect()}
    s, c = int(counts.get("train", 0)), int(counts.get("control", 0))
    risk, lo, hi = residual_risk(s, c, n, nc)
    return AttackResult("Linkability", risk, lo, hi, n, False,
                        f"aux_cols={len(a)}/{len(a) + len(b)} | n_success={s} | n_control_success={c}", s, c)
