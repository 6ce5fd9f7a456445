"""Cleaning: drops and imputation.

``load_and_clean(df, key)`` = R1 → profile (one action) → R2–R5 drops →
imputation per column kind → R14 guard → result.  Fill values are
computed by scale-safe aggregates:

* median (I5): exact, by bracketing with ``percentile_approx`` and ranking
  only the rows inside the bracket (no global value map, no global sort);
* mode (I3): ``groupBy(value).count()`` (partial aggregation), highest
  count, smallest value on ties; ``"Unknown"`` when there is none;
* forward/back fill (I2): rows are bucketed by key quantiles; a window per
  bucket fills inside it and the last/first non-null value of every bucket
  is carried across buckets through a table of one row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from synthaudit.config import LoaderConfig
from synthaudit.operators.profile import CleaningPlan, apply_types, drop_null_rows, profile


class LoaderError(Exception):
    """Raised when loading or validation fails."""


EXACT_ROWS = 100_000      # rank inside a bracket this small
FILL_BUCKET_ROWS = 1_000_000   # target rows per fill bucket
MAX_FILL_BUCKETS = 100_000


def exact_median(df: DataFrame, col: str) -> float | None:
    """I5 for one column."""
    return exact_medians(df, [col])[col]


def exact_medians(df: DataFrame, cols: list[str]) -> dict:
    """Exact medians (mean of the two middle values) of several columns,
    all of them in the same few passes.

    Every round narrows each column's bracket ``[lo, hi]`` around its middle
    ranks with ``percentile_approx`` and exact counts, until at most
    ``EXACT_ROWS`` rows are inside; those are ranked exactly.  A bracket that
    misses is widened, a bracket of one repeated value answers at once, and if
    ties keep a bracket large, Spark's exact ``percentile`` runs inside it."""
    if not cols:
        return {}
    number = {c: F.col(f"`{c}`").cast("double") for c in cols}
    number = {c: F.when(~F.isnan(x), x) for c, x in number.items()}
    n = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(number.values())]).first()
    size = {c: n[f"n{i}"] for i, c in enumerate(cols)}
    found = {c: None for c in cols if not size[c]}
    middle = {c: ((size[c] - 1) // 2, size[c] // 2) for c in cols}        # 0-based ranks wanted
    inside, offset, eps, tied = dict(number), dict.fromkeys(cols, 0), dict.fromkeys(cols, 5e-4), set()
    for _ in range(12):
        big = [c for c in cols if c not in found and c not in tied and size[c] > EXACT_ROWS]
        if not big:
            break
        ends = df.agg(*[F.percentile_approx(inside[c], [
            max(0.0, (middle[c][0] - offset[c]) / size[c] - eps[c]),
            min(1.0, (middle[c][1] - offset[c]) / size[c] + eps[c])], 10_000).alias(f"e{i}") for i, c in enumerate(big)]).first()
        counts = []
        for i, c in enumerate(big):
            lo, hi = ends[f"e{i}"]
            counts += [F.count_if(inside[c] < lo).alias(f"b{i}"), F.count_if(inside[c].between(lo, hi)).alias(f"i{i}")]
        got = df.agg(*counts).first()
        for i, c in enumerate(big):
            (lo, hi), below, within = ends[f"e{i}"], got[f"b{i}"], got[f"i{i}"]
            if not (offset[c] + below <= middle[c][0] and middle[c][1] < offset[c] + below + within):
                eps[c] *= 4                                   # the approximate bracket missed
            elif lo == hi:                                    # both middle ranks hold this value
                found[c] = float(lo)
            elif within >= size[c]:                           # ties: no progress
                tied.add(c)
            else:
                inside[c] = F.when(number[c].between(lo, hi), number[c])
                offset[c], size[c], eps[c] = offset[c] + below, within, 5e-4
    left, ask = [c for c in cols if c not in found], []
    for i, c in enumerate(left):
        ranks = [r - offset[c] for r in middle[c]]
        if size[c] <= EXACT_ROWS:        # a sketch with room for every value: p = (r + 1/2) / size is rank r
            ask.append(F.percentile_approx(inside[c], [(r + 0.5) / size[c] for r in ranks], 10 * EXACT_ROWS).alias(f"m{i}"))
        else:
            at = F.array(*[F.lit(min(1.0, max(0.0, r / (size[c] - 1)))) for r in ranks])
            ask.append(F.percentile(inside[c], at).alias(f"m{i}"))
    row = df.agg(*ask).first() if ask else {}
    for i, c in enumerate(left):
        found[c] = sum(row[f"m{i}"]) / 2.0
    return found


def mode_values(df: DataFrame, cols: list[str]) -> dict:
    """I3 for several text columns at once: per column the most frequent
    non-null value, smallest on ties (None if the column has no value).
    Counts per (column, value) are partially aggregated; the maximum per
    column and the tie-break are aggregates too (a column's domain never
    sits in one task)."""
    if not cols:
        return {}
    arr = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    counts = (df.select(F.explode(arr).alias("e")).where(F.col("e.v").isNotNull())
              .groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n")))
    top = counts.groupBy("c").agg(F.max("n").alias("n"))
    best = counts.join(F.broadcast(top), ["c", "n"]).groupBy("c").agg(F.min("v").alias("v"))  # top: one row per column
    found = {r["c"]: r["v"] for r in best.collect()}
    return {c: found.get(c) for c in cols}


def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value; smallest on ties; None if none."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("m")).first()["m"]
    if top is None:
        return None
    return counts.where(F.col("n") == top).agg(F.min(col)).first()[0]


def key_buckets(df: DataFrame, key: str, n_rows: int, rows_per_bucket: int = FILL_BUCKET_ROWS):
    """Bucket id by approximate key quantiles: equal-sized, ordered buckets
    whose number grows with the data (binary search per row)."""
    from pyspark.ml.feature import Bucketizer

    nb = max(1, min(MAX_FILL_BUCKETS, -(-n_rows // rows_per_bucket)))
    if nb == 1:
        return df.withColumn("__b", F.lit(0.0)), 1
    probs = [i / nb for i in range(1, nb)]
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), probs, max(10_000, 10 * nb))).first()[0] or []
    splits = [float("-inf")] + sorted(set(cuts)) + [float("inf")]
    d = df.withColumn("__kd", F.col(key).cast("double"))
    d = Bucketizer(splits=splits, inputCol="__kd", outputCol="__b").transform(d).drop("__kd")
    return d, len(splits) - 1


def ffill_bfill(df: DataFrame, key: str, cols: list[str], n_rows: int | None = None) -> DataFrame:
    """Forward fill then back fill in key order, for several columns."""
    if not cols:
        return df
    n_rows = n_rows if n_rows is not None else df.count()
    db, nb = key_buckets(df, key, n_rows)
    d = db
    # Both directions are running frames (O(n) per bucket); a frame
    # "current .. unbounded following" would be re-aggregated per row.
    w_pre = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    w_post = Window.partitionBy("__b").orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    for c in cols:
        d = d.withColumn(f"__f_{c}", F.last(c, True).over(w_pre)).withColumn(f"__g_{c}", F.last(c, True).over(w_post))
    if nb == 1:                                        # one bucket: nothing to carry
        return d.select(*[F.coalesce(F.col(f"__f_{c}"), F.col(f"__g_{c}")).alias(c) if c in cols else F.col(c)
                          for c in df.columns])
    # one row per bucket: last / first non-null value (by key)
    per = db.groupBy("__b").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(key))).alias(f"__l_{c}") for c in cols],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(key))).alias(f"__r_{c}") for c in cols])
    wb_pre = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    wb_post = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("__b", *[F.last(f"__l_{c}", True).over(wb_pre).alias(f"__p_{c}") for c in cols],
                       *[F.last(f"__r_{c}", True).over(wb_post).alias(f"__n_{c}") for c in cols])
    d = d.join(F.broadcast(carry), "__b", "left")    # one row per bucket (≤ MAX_FILL_BUCKETS)
    out = []
    for c in df.columns:
        if c in cols:
            out.append(F.coalesce(F.col(f"__f_{c}"), F.col(f"__p_{c}"), F.col(f"__g_{c}"), F.col(f"__n_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


@dataclass
class LoaderResult:
    df: DataFrame
    plan: CleaningPlan
    original_shape: tuple
    cleaned_shape: tuple
    dropped_columns: list
    imputation_log: list = field(default_factory=list)   # (column, strategy, fill_value, n)

    def log_text(self) -> dict:
        """I7 as text for people: column -> strategy description."""
        out = {}
        for c, strategy, fill, n in self.imputation_log:
            if strategy == "ffill+bfill":
                out[c] = f"ffill+bfill ({n} nulls)"
            elif strategy == "mode":
                out[c] = f"mode='{fill}' ({n} nulls)"
            elif strategy == "median":
                out[c] = f"median={float(fill):.4g} ({n} nulls)" if fill is not None else f"median=nan ({n} nulls)"
            else:
                out[c] = f"rows_dropped ({n} rows)"
        return out

    def log_frame(self, spark):
        text = self.log_text()
        return spark.createDataFrame([(c, s, v, n, text[c]) for c, s, v, n in self.imputation_log],
                                     "column string, strategy string, fill_value string, n bigint, text string")


def impute(df: DataFrame, plan: CleaningPlan, key: str, cfg: LoaderConfig | None = None):
    """I2–I7 in column order; returns (DataFrame, log rows)."""
    cfg = cfg or LoaderConfig()
    log = []
    dt_cols = []
    # modes of all text columns with gaps in one pass (no row drop precedes
    # them unless an unsupported-type column drops rows first)
    early_drop = any(ci.kind == "other" and ci.n_null > 0 for ci in plan.columns.values())
    cat_gaps = [c for c, ci in plan.columns.items() if ci.kind == "categorical" and ci.n_null > 0]
    modes = {} if early_drop else mode_values(df, cat_gaps)
    medians = {} if early_drop else exact_medians(
        df, [c for c, ci in plan.columns.items() if ci.kind == "numeric" and ci.n_null > 0])
    for c, ci in plan.columns.items():
        if ci.n_null == 0:
            if cfg.trim == "all" and ci.kind == "categorical":
                df = df.withColumn(c, F.trim(F.col(c)))
            continue
        if ci.kind == "datetime":
            dt_cols.append(c)
            log.append((c, "ffill+bfill", None, ci.n_null))
        elif ci.kind == "categorical":
            v = modes[c] if c in modes else mode_value(df, c)
            fill = v if v is not None else "Unknown"
            if isinstance(df.schema[c].dataType, T.BooleanType):
                df = df.withColumn(c, F.coalesce(F.col(c), F.lit(str(fill).lower() == "true")))
            else:
                df = df.withColumn(c, F.trim(F.coalesce(F.col(c), F.lit(fill)).cast("string")))  # I4 (D6)
            log.append((c, "mode", str(fill), ci.n_null))
        elif ci.kind == "numeric":
            m = medians[c] if c in medians else exact_median(df, c)
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(m)))
            log.append((c, "median", None if m is None else repr(m), ci.n_null))
        else:
            before = None
            df = df.where(F.col(c).isNotNull())                       # R13 / I6
            log.append((c, "rows_dropped", before, ci.n_null))
    df = ffill_bfill(df, key, dt_cols, plan.n_rows)
    return df, log


def load_and_clean(df: DataFrame, key: str, cfg: LoaderConfig | None = None, check: bool = True) -> LoaderResult:
    """The whole cleaning pipeline on a keyed DataFrame."""
    cfg = cfg or LoaderConfig()
    d = drop_null_rows(apply_types(nan_to_null(df), cfg.metadata_overrides), key)      # R19, R1
    plan = profile(d, key, cfg)                                       # R2-R4, R6-R8 (action)
    keep = [key] + [c for c in plan.columns]                          # R5
    d = d.select(*keep)
    d, log = impute(d, plan, key, cfg)
    n_after = d.count() if check or any(s == "rows_dropped" for _, s, _, _ in log) else plan.n_rows
    res = LoaderResult(d, plan, (plan.n_rows, plan.n_cols), (n_after, len(keep) - 1), plan.dropped, log)
    if check:
        validate(res, cfg)
    return res


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of a typed source is a missing value like any other."""
    return df.select(*[F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def validate(res: LoaderResult, cfg: LoaderConfig) -> None:
    """Enough rows and at least two columns must survive."""
    n, p = res.cleaned_shape
    if n < cfg.min_rows_after_cleaning:
        raise LoaderError(f"{n} rows left after cleaning, {cfg.min_rows_after_cleaning} needed")
    if p < 2:
        raise LoaderError(f"{p} column(s) left after cleaning, 2 needed")


def drop_rows_null_in(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows that are NULL in any of the given columns."""
    return df.na.drop(subset=cols)
