"""Column statistics: bounds, means, Pearson correlation, similarity.

Correlation (G4) is pairwise-complete Pearson computed from centred sums:
pass 1 takes column means (p numbers to the driver), pass 2 one aggregate
of ``n, Σx', Σy', Σx'², Σy'², Σx'y'`` per pair over rows where both are
non-null (``x' = x − mean``).  Division is guarded, so a constant column
gives NULL instead of an ANSI divide-by-zero.  Wide tables (many pairs) use
per-partition Gram blocks in ``mapInPandas`` summed by ``groupBy``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthaudit.functions.columns import feature_columns, numeric_columns
from synthaudit.functions.shipping import ship_package

# Above this many pairs the fused aggregate gets too wide for codegen.
GRAM_PAIR_LIMIT = 120


@dataclass
class ColumnProfile:
    """Per-column statistics of one table, computed in one aggregate."""
    n_rows: int
    n_null: dict
    minimum: dict
    maximum: dict
    mean: dict
    stddev_pop: dict

    @classmethod
    def of(cls, df: DataFrame, key: str | None = None) -> "ColumnProfile":
        cols = feature_columns(df, key)
        nums = numeric_columns(df, key, include_bool=True)
        aggs = [F.count(F.lit(1)).alias("__n")]
        for i, c in enumerate(cols):
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"__z{i}"))
        for i, c in enumerate(nums):
            x = F.col(c).cast("double")
            aggs += [F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}"),
                     F.avg(x).alias(f"__mu{i}"), F.stddev_pop(x).alias(f"__sd{i}")]
        r = df.agg(*aggs).first()
        return cls(
            n_rows=int(r["__n"]),
            n_null={c: int(r[f"__z{i}"]) for i, c in enumerate(cols)},
            minimum={c: r[f"__lo{i}"] for i, c in enumerate(nums)},
            maximum={c: r[f"__hi{i}"] for i, c in enumerate(nums)},
            mean={c: r[f"__mu{i}"] for i, c in enumerate(nums)},
            stddev_pop={c: r[f"__sd{i}"] for i, c in enumerate(nums)},
        )


def column_bounds(df: DataFrame, key: str | None = None) -> DataFrame:
    """``(column, min_value, max_value)`` of every numeric column, one pass."""
    nums = numeric_columns(df, key)
    aggs = []
    for c in nums:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.min(x).alias("min_value"),
                             F.max(x).alias("max_value")))
    return df.agg(F.array(*aggs).alias("b")).select(F.inline("b"))


def _centred_pair_aggs(cols: list[str], means: dict) -> list[Column]:
    aggs = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            m = F.col(a).isNotNull() & F.col(b).isNotNull()
            xa = F.col(a).cast("double") - F.lit(means[a] or 0.0)
            xb = F.col(b).cast("double") - F.lit(means[b] or 0.0)
            aggs.append(F.struct(
                F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                F.count_if(m).cast("double").alias("n"),
                F.sum(F.when(m, xa)).alias("sa"), F.sum(F.when(m, xb)).alias("sb"),
                F.sum(F.when(m, xa * xa)).alias("saa"), F.sum(F.when(m, xb * xb)).alias("sbb"),
                F.sum(F.when(m, xa * xb)).alias("sab")))
    return aggs


TILE = 128                  # columns of a block of the Gram matrix
FAN_IN = 64                 # blocks added up by one task
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _gram_blocks(df: DataFrame, cols: list[str], means: dict) -> DataFrame:
    """Masked Gram sums of centred columns: every task sends one packed row for
    each block of ``TILE`` by ``TILE`` columns, and blocks are added up in a
    tree of ``FAN_IN`` tasks' blocks at a time."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    mu = np.array([means[c] or 0.0 for c in cols], dtype="float64")
    p, tile = len(cols), TILE
    edges = [(k, min(p, k + tile)) for k in range(0, p, tile)]

    def blocks(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["task", "i", "j", "sums"])

    def part(batches):
        acc = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype("float64") - mu
            m = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x, nan=0.0)
            got = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            acc = got if acc is None else acc + got
        if acc is not None:
            task = TaskContext.get().partitionId()
            yield blocks([(task, i0, j0, np.ascontiguousarray(acc[:, i0:i1, j0:j1]).tobytes())
                          for i0, i1 in edges for j0, j1 in edges if i0 <= j0])

    def added(table):
        return np.sum([np.frombuffer(v.as_buffer()) for v in table.column("sums")], axis=0)

    def add(key, table):
        return pa.Table.from_batches([blocks([(*(k.as_py() for k in key), added(table).tobytes())])])

    def unpack(key, table):
        i0, j0 = (k.as_py() for k in key)
        shape = (len(_SUMS), min(tile, p - i0), min(tile, p - j0))
        s = added(table).reshape(shape)
        i, j = np.meshgrid(np.arange(i0, i0 + shape[1]), np.arange(j0, j0 + shape[2]), indexing="ij")
        above = i < j
        return pa.table({"i": pa.array(i[above], pa.int32()), "j": pa.array(j[above], pa.int32()),
                         **{c: pa.array(s[k][above]) for k, c in enumerate(_SUMS)}})

    ship_package(df.sparkSession)
    schema = "task long, i long, j long, sums binary"
    sums = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(part, schema)
    for _ in range(2):
        sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task", "i", "j").applyInArrow(add, schema)
    summed = sums.groupBy("i", "j").applyInArrow(unpack, "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS))
    name_map = F.array(*[F.lit(c) for c in cols])
    return summed.select(F.element_at(name_map, F.col("i") + 1).alias("col_a"),
                         F.element_at(name_map, F.col("j") + 1).alias("col_b"), *_SUMS)


def _corr_from_sums(df: DataFrame) -> DataFrame:
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    r = F.when((n > 1) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    # clamp the last-bit overshoot of |r| > 1
    # (greatest/least skip NULL, so clamp only defined values)
    r = F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    return df.select("col_a", "col_b", r.alias("corr"))


def correlation_matrix(df: DataFrame, key: str | None = None, cols: list[str] | None = None,
                       means: dict | None = None) -> DataFrame:
    """Long correlation matrix ``(col_a, col_b, corr)`` for pairs a < b in
    column order; NULL where undefined (constant column, < 2 rows)."""
    cols = cols if cols is not None else numeric_columns(df, key, include_bool=True)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    if means is None:
        r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        means = {c: r[f"m{i}"] for i, c in enumerate(cols)}
    if len(cols) * (len(cols) - 1) // 2 <= GRAM_PAIR_LIMIT:
        sums = df.agg(F.array(*_centred_pair_aggs(cols, means)).alias("s")).select(F.inline("s"))
    else:
        sums = _gram_blocks(df, cols, means)
    return _corr_from_sums(sums)


def shared_numeric_columns(real: DataFrame, syn: DataFrame, key: str | None = None) -> list[str]:
    """Numeric (incl. bool) columns of real that syn also has, real's order."""
    syn_nums = set(numeric_columns(syn, key, include_bool=True))
    return [c for c in numeric_columns(real, key, include_bool=True) if c in syn_nums]


def correlation_similarity_from(real_corr: DataFrame, syn_corr: DataFrame, n_cols: int) -> DataFrame:
    """G5 from two long matrices: ``1 − Σ_{i≠j}|Δr| / (n(n−1))``; NULL if any
    correlation is undefined (decision D9)."""
    if n_cols < 2:
        return real_corr.sparkSession.createDataFrame([(0.0,)], "correlation_similarity double")
    j = real_corr.alias("r").join(syn_corr.alias("s"), ["col_a", "col_b"])
    d = F.abs(F.col("r.corr") - F.col("s.corr"))
    total = F.sum(d)
    undefined = F.count_if(d.isNull()) > 0
    score = F.when(undefined, F.lit(None).cast("double")).otherwise(
        1.0 - 2.0 * total / float(n_cols * (n_cols - 1)))
    return j.agg(score.alias("correlation_similarity"))


def correlation_similarity(real: DataFrame, syn: DataFrame, key: str | None = None) -> DataFrame:
    cols = shared_numeric_columns(real, syn, key)
    return correlation_similarity_from(correlation_matrix(real, cols=cols),
                                       correlation_matrix(syn, cols=cols), len(cols))


def correlation_difference(real: DataFrame, syn: DataFrame, key: str | None = None) -> DataFrame:
    """V1: signed ``corr(real) − corr(syn)`` per pair (heat-map data)."""
    cols = shared_numeric_columns(real, syn, key)
    r = correlation_matrix(real, cols=cols).withColumnRenamed("corr", "corr_real")
    s = correlation_matrix(syn, cols=cols).withColumnRenamed("corr", "corr_syn")
    return r.join(s, ["col_a", "col_b"]).select(
        "col_a", "col_b", "corr_real", "corr_syn",
        (F.col("corr_real") - F.col("corr_syn")).alias("corr_diff"))


def zscore(df: DataFrame, profile: ColumnProfile, cols: list[str], key: str | None = None,
           fill_zero: bool = True, carry: dict | None = None) -> DataFrame:
    """``(x − mean)/std_pop`` with the *real* table's statistics;
    NULL → 0 first; zero std divides by 1.  ``carry`` (new name → column)
    comes along unscaled."""
    out = [F.col(key)] if key else []
    out += [F.col(f"`{c}`").alias(name) for name, c in (carry or {}).items()]
    for c in cols:
        x = F.col(c).cast("double")
        if fill_zero:
            x = F.coalesce(x, F.lit(0.0))
        sd = profile.stddev_pop.get(c) or 0.0
        out.append(((x - F.lit(profile.mean[c])) / F.lit(sd if sd > 0 else 1.0)).alias(c))
    return df.select(*out)


def zero_filled_profile(df: DataFrame, cols: list[str]) -> ColumnProfile:
    """Mean and population std of the columns after NULL → 0 (for G9)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    aggs.append(F.count(F.lit(1)).alias("n"))
    r = df.agg(*aggs).first()
    return ColumnProfile(n_rows=int(r["n"]), n_null={}, minimum={}, maximum={},
                         mean={c: r[f"m{i}"] for i, c in enumerate(cols)},
                         stddev_pop={c: r[f"s{i}"] for i, c in enumerate(cols)})
