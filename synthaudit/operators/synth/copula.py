"""Gaussian copula synthesizer.

Fit (only p-sized results reach the driver):
* numeric marginals: up to 1,001 quantile knots per column (at most about
  half the column's values, so interpolation never replays a real value
  between tied knots), exact (``values_at_ranks``: a few counting passes that
  all columns share), plus the NULL share;
* categorical marginals: ``groupBy(column, value).count()`` over the
  unpivoted categorical columns (NULL is a category); more values than
  ``MAX_CATEGORIES`` share codes by hash, and a sampled code draws one of them;
* dependence: every row is mapped to normal scores (position between
  knots, middle of the step on ties; middle of the category's frequency
  interval) and each task emits its partial Gram matrix of scores; a
  ``groupBy(i, j).sum`` adds them up; Cholesky of the correlation.
Sample: ``spark.range(n)`` with seeded hash uniforms per column (same rows
on any partitioning) → independent normals → ``· Lᵀ`` → Φ → marginal
inverse.  Numeric values stay inside the real [min, max]; integral
columns are rounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.functions import normal
from synthaudit.functions.columns import is_time_type, number_to_time, time_to_number
from synthaudit.functions.uniform import hash_uniform
from synthaudit.operators.ranks import knot_ranks, values_at_ranks
from synthaudit.operators.synth.base import Synthesizer, register
from synthaudit.operators.synth.spread import Spread, sample_ids, shared_code

N_KNOTS = 1001
MAX_CATEGORIES = 100_000   # codes per column in the table shipped to tasks; more values share them by hash
U_EPS = 1e-6


def _num_scores(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    probs = np.linspace(0.0, 1.0, len(knots))
    lo = np.searchsorted(knots, x, "left")
    hi = np.searchsorted(knots, x, "right")
    u = np.interp(x, knots, probs)
    tie = (hi - lo) > 1
    u = np.where(tie, (lo + hi - 1) / 2.0 / (len(knots) - 1), u)
    u = np.clip(u, U_EPS, 1 - U_EPS)
    z = normal.ppf(u)
    return np.where(np.isnan(x), 0.0, z)


def _cat_scores(vals, table) -> np.ndarray:
    """Normal score of each category (NULL is a category), vectorised."""
    known = [v for v in table["values"] if v is not None]
    zs = np.array([table["z"][v] for v in known] + [0.0])
    z_null = table["z"].get(None, 0.0)
    ser = pd.Series(vals, dtype=object)
    codes = pd.Categorical(ser, categories=known).codes
    out = zs[np.where(codes < 0, len(known), codes)]
    return np.where(pd.isna(ser).to_numpy(), z_null, out)


@register
class GaussianCopula(Synthesizer):
    name = "copula"

    def _fit(self, df: DataFrame, key: str) -> None:
        fields = [f for f in df.schema.fields if f.name != key]
        self.fields = fields
        # dates and timestamps are modelled as numbers (epoch days / microseconds)
        self.times = {f.name: f.dataType for f in fields if is_time_type(f.dataType)}
        if self.times:
            df = df.select(key, *[time_to_number(f.name, f.dataType).alias(f.name) if f.name in self.times
                                  else F.col(f.name) for f in fields])
        self.nums = [f.name for f in fields if isinstance(f.dataType, T.NumericType) or f.name in self.times]
        self.cats = [f.name for f in fields if f.name not in self.nums]
        # knots per column: 1,001, but at most about half the non-null values, so that
        # adjacent knots differ and interpolated values do not replay real ones
        cnt = df.agg(F.count(F.lit(1)).alias("__n"),
                     *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(self.nums)]).first()
        n = int(cnt["__n"])
        knots_n = {c: max(2, min(N_KNOTS, int(cnt[f"c{i}"]) // 2 + 1)) for i, c in enumerate(self.nums)}
        some = [c for i, c in enumerate(self.nums) if cnt[f"c{i}"]]
        size = {c: int(cnt[f"c{i}"]) for i, c in enumerate(self.nums)}
        found = dict(zip(some, values_at_ranks(df, some, [knot_ranks(size[c], knots_n[c]) for c in some]))) if some else {}
        r_n = {f"z{i}": n - int(cnt[f"c{i}"]) for i in range(len(self.nums))}
        self.n_rows = n
        self.knots = {c: found.get(c, np.zeros(1)) for c in self.nums}
        self.p_null = {c: r_n[f"z{i}"] / n if n else 0.0 for i, c in enumerate(self.nums)}
        self.integral = {f.name: isinstance(f.dataType, T.IntegralType) or f.name in self.times for f in fields}
        self.cat_tables, self.spread = {}, {}
        if self.cats:
            arr = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in self.cats])
            cnt = (df.select(F.explode(arr).alias("e")).groupBy("e.c", "e.v")
                   .agg(F.count(F.lit(1)).alias("n")).persist())
            sizes = {r_["c"]: r_["count"] for r_ in cnt.groupBy("c").count().collect()}
            wide = [c for c in self.cats if sizes.get(c, 0) > MAX_CATEGORIES]
            for c in wide:      # more values than codes: they share them
                self.spread[c] = Spread(cnt.where((F.col("c") == c) & F.col("v").isNotNull()).select("v", "n"),
                                        MAX_CATEGORIES, sizes[c])
                df = df.withColumn(c, shared_code(F.col(f"`{c}`").cast("string"), MAX_CATEGORIES))
            code = F.when(F.col("c").isin(wide), shared_code(F.col("v"), MAX_CATEGORIES)).otherwise(F.col("v"))
            rows = cnt.groupBy("c", code.alias("v")).agg(F.sum("n").alias("n")).collect()   # at most MAX_CATEGORIES + 1 a column
            cnt.unpersist()
            for c in self.cats:
                items = sorted(((r_["v"], r_["n"]) for r_ in rows if r_["c"] == c),
                               key=lambda t: (t[0] is not None, t[0] or ""))
                tot = float(sum(k for _, k in items)) or 1.0
                cum = np.cumsum([k for _, k in items]) / tot
                lo = np.concatenate([[0.0], cum[:-1]])
                mids = (lo + cum) / 2.0
                self.cat_tables[c] = {"values": [v for v, _ in items], "cum": cum,
                                      "counts": [k for _, k in items],
                                      "z": {v: float(z) for (v, _), z in zip(items, normal.ppf(mids))}}
        self.cols = self.nums + self.cats
        self.corr = self._score_correlation(df)
        self.chol = self._cholesky(self.corr)

    def _score_correlation(self, df: DataFrame) -> np.ndarray:
        cols, nums, cats = self.cols, self.nums, self.cats
        knots, tables = self.knots, self.cat_tables
        p = len(cols)

        def part(batches):
            s = np.zeros((p, p))
            m = np.zeros(p)
            cnt = 0
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                z = np.empty((len(pdf), p))
                for j, c in enumerate(nums):
                    z[:, j] = _num_scores(pdf[c].to_numpy(dtype="float64", na_value=np.nan), knots[c])
                for j, c in enumerate(cats):
                    z[:, len(nums) + j] = _cat_scores(pdf[c], tables[c])
                s += z.T @ z
                m += z.sum(axis=0)
                cnt += len(pdf)
            if cnt == 0:
                return
            ii, jj = np.meshgrid(np.arange(p), np.arange(p), indexing="ij")
            rows = pd.DataFrame({"i": ii.ravel(), "j": jj.ravel(), "v": s.ravel()})
            rows = pd.concat([rows, pd.DataFrame({"i": np.arange(p), "j": -1, "v": m}),
                              pd.DataFrame({"i": [-1], "j": [-1], "v": [float(cnt)]})])
            yield rows.astype({"i": "int32", "j": "int32", "v": "float64"})

        sel = df.select(*[F.col(c).cast("double").alias(c) if c in nums else F.col(c).cast("string").alias(c)
                          for c in cols])
        got = sel.mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        s = np.zeros((p, p))
        m = np.zeros(p)
        n = 0.0
        for r in got:
            if r["i"] == -1:
                n = r["v"]
            elif r["j"] == -1:
                m[r["i"]] = r["v"]
            else:
                s[r["i"], r["j"]] = r["v"]
        if n <= 1:
            return np.eye(p)
        mu = m / n
        cov = s / n - np.outer(mu, mu)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        sd[sd == 0] = 1.0
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 1.0)
        return np.clip(corr, -1.0, 1.0)

    @staticmethod
    def _cholesky(corr: np.ndarray) -> np.ndarray:
        ridge = 0.0
        for _ in range(12):
            try:
                return np.linalg.cholesky(corr + ridge * np.eye(len(corr)))
            except np.linalg.LinAlgError:
                ridge = 1e-8 if ridge == 0 else ridge * 10
        return np.eye(len(corr))

    def _sample(self, n: int, seed: int) -> DataFrame:
        spark = self.spark
        cols, nums, cats = self.cols, self.nums, self.cats
        knots, tables, p_null, chol = self.knots, self.cat_tables, self.p_null, self.chol
        integral = self.integral
        ids = sample_ids(spark, n)
        u_cols = [hash_uniform(seed, f"copula|{c}", F.col("id")).alias(f"u{j}") for j, c in enumerate(cols)]
        null_cols = [hash_uniform(seed, f"copula-null|{c}", F.col("id")).alias(f"w{j}") for j, c in enumerate(nums)]
        src = ids.select("id", *u_cols, *null_cols)
        p = len(cols)

        def part(batches):
            for pdf in batches:
                u = pdf[[f"u{j}" for j in range(p)]].to_numpy(dtype="float64")
                z = normal.ppf(u) @ chol.T
                uu = np.clip(normal.cdf(z), 0.0, 1.0)
                out = {self_key: pdf["id"].to_numpy(dtype="int64")}
                for j, c in enumerate(nums):
                    k = knots[c]
                    v = np.interp(uu[:, j], np.linspace(0.0, 1.0, len(k)), k)
                    if integral[c]:
                        v = np.round(v)
                    v = np.where(pdf[f"w{j}"].to_numpy() < p_null[c], np.nan, v)
                    out[c] = v
                for j, c in enumerate(cats):
                    t = tables[c]
                    idx = np.minimum(np.searchsorted(t["cum"], uu[:, len(nums) + j], "right"), len(t["values"]) - 1)
                    out[c] = np.asarray(t["values"], dtype=object)[idx]
                yield pd.DataFrame(out)

        self_key = self.key
        schema = T.StructType([T.StructField(self_key, T.LongType())] + [T.StructField(c, T.DoubleType()) for c in nums]
                              + [T.StructField(c, T.StringType()) for c in cats])
        raw = src.mapInPandas(part, schema)
        for c, spread in self.spread.items():       # a shared code draws one of its values
            raw = spread.draw(raw, c, hash_uniform(seed, f"copula-value|{c}", F.col(self_key)))
        # back to the original column order and types
        out = [F.col(self_key)]
        for f in self.fields:
            if f.name in self.times:
                out.append(number_to_time(f.name, f.dataType).alias(f.name))
            else:
                out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        return raw.select(*out)
