"""Structural checks of synthetic data against real.

A. Boundary: a synthetic numeric value outside the real ``[min, max]``
   (NULL is not a violation).  Each numeric column adds ``n_syn`` cells.
B. Null invariance: a column with no NULL in real must have none in
   synthetic.  Each such column adds ``n_syn`` cells.
Score: ``max(0, 1 − violations / cells)``, 1.0 when nothing is checked.

The real side is a :class:`ColumnProfile` (computed once per audit); the
synthetic side is a single aggregate, so the whole check is one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.columns import feature_columns, numeric_columns
from synthaudit.operators.stats import ColumnProfile


def logic_aggregate(profile: ColumnProfile, real_cols: list[str], real_nums: list[str],
                    syn: DataFrame, extra: list | None = None) -> DataFrame:
    """One-row aggregate over syn: ``n_rows`` and an array of
    ``struct(column, kind, violation_key, n)`` for every checked column."""
    syn_cols = set(syn.columns)
    checks = []
    for c in real_nums:
        if c not in syn_cols:
            continue
        x = F.col(c).cast("double")
        lo, hi = profile.minimum[c], profile.maximum[c]
        if lo is None:
            cond = F.lit(False)
        else:
            cond = (x < F.lit(lo)) | (x > F.lit(hi))
        checks.append(F.struct(F.lit(c).alias("column"), F.lit("boundary").alias("kind"),
                               F.lit(f"{c}_boundary").alias("violation_key"),
                               F.count_if(cond).cast("long").alias("n")))
    for c in real_cols:
        if c not in syn_cols or profile.n_null.get(c, 1) != 0:
            continue
        checks.append(F.struct(F.lit(c).alias("column"), F.lit("unexpected_nulls").alias("kind"),
                               F.lit(f"{c}_unexpected_nulls").alias("violation_key"),
                               F.count_if(F.col(c).isNull()).cast("long").alias("n")))
    if not checks:
        checks_col = F.array().cast("array<struct<column:string,kind:string,violation_key:string,n:bigint>>")
    else:
        checks_col = F.array(*checks)
    return syn.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), checks_col.alias("checks"), *(extra or []))


def violations(agg: DataFrame, kind: str | None = None) -> DataFrame:
    """G6/G7 breakdown rows with a positive count."""
    out = agg.select(F.inline("checks")).where(F.col("n") > 0)
    if kind:
        out = out.where(F.col("kind") == kind)
    return out.select("column", "violation_key", F.col("n").alias("n_violations"))


def logic_score(agg: DataFrame) -> DataFrame:
    """``(n_rows, n_cells, n_violations, logic_consistency)``."""
    n_checks = F.size("checks").cast("long")
    cells = F.col("n_rows") * n_checks
    viol = F.aggregate("checks", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    score = F.when(cells == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - viol.cast("double") / cells.cast("double")))
    return agg.select("n_rows", cells.alias("n_cells"), viol.alias("n_violations"),
                      score.alias("logic_consistency"))


def logic_check(real: DataFrame, syn: DataFrame, key: str | None = None,
                profile: ColumnProfile | None = None) -> DataFrame:
    """Cached one-row logic aggregate of syn against real."""
    profile = profile or ColumnProfile.of(real, key)
    return logic_aggregate(profile, feature_columns(real, key), numeric_columns(real, key), syn)
