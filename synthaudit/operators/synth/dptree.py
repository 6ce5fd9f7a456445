"""Differentially private spanning-tree synthesizer.

Registered as ``privbayes`` (the original tool's name for its spanning-tree
model).  Fit:
* numeric columns are cut into ``bins`` equal bins between declared
  bounds; bounds not declared are estimated with the preprocessing budget
  from a noisy histogram over a fixed log-scale grid (data-independent);
  NULL is its own bin / category;
* text values are numbered per column.  With ``delta`` the set of values is
  private, too: a value is released if its noisy count reaches a threshold
  (at least ``min_count``) that a single row passes with probability at most
  ``delta``; the others share the code ``OTHER``.  ``DOMAIN_SHARE`` of the
  budget pays for it.  Without ``delta`` the values are read from the data,
  as by the library the original tool calls, so epsilon covers counts only;
* a text column with more than ``MAX_DOMAIN`` values is modelled on that
  many codes shared by hash; the shares of a code's values come from noisy
  counts too (``VALUE_SHARE`` of the budget);
* all 1- and 2-way counts in one pass (each task counts its cells), then
  Laplace noise on every cell of the domain, also the empty ones, by a secret
  seed and the cell, so a lost task computes it again alike; budget split 1/3
  to 1-way, 2/3 to 2-way marginals (sequential composition).  The noisy cells
  are a Spark table;
* mutual information by aggregates over that table (p * p / 2 numbers reach
  the driver), maximum spanning tree, and conditional shares along the tree as
  a Spark table of intervals.
Sample: ``spark.range(n)`` + seeded hash uniforms; the root and then each
child is drawn by a join on (parent's code, cell of the uniform), numeric
values are uniform inside their bin, integral columns rounded.

Noise comes from OS entropy unless ``noise_seed`` is given (tests only).
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.functions.columns import is_time_type, number_to_time, time_to_number
from synthaudit.functions.uniform import hash_uniform
from synthaudit.operators.synth.base import REGISTRY, Synthesizer, register
from synthaudit.operators.synth.spread import Spread, sample_ids, shared_code
from synthaudit.session import cut_lineage

MAX_DOMAIN = 1_000          # codes per text column in the model; more values share them by hash
NULL_CODE = "\u0000"        # code of NULL for categorical columns
OTHER = "(other)"           # shared by text values that are not released
DOMAIN_SHARE = 0.1          # part of the budget for choosing the released values, with ``delta``
DENSE_CELLS = 1 << 16       # tables up to this size are counted densely in a task
SMALL_TABLE = 250_000       # cells of a conditional table that is broadcast
JOINS_A_STEP = 16           # draws between two written steps of a sample
VALUE_SHARE = 0.1           # part of the budget for the value shares of shared codes, if there are any
# Exponents of the log-scale grid used to estimate bounds.
GRID_EXP = range(-3, 13)


def numeric_bin(c: str, lo: float, hi: float, bins: int) -> Column:
    w = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(c).cast("double")
    # clamped as a double: a value far beyond the bounds has no integer bin
    b = F.least(F.lit(bins - 1.0), F.greatest(F.lit(0.0), (x - F.lit(lo)) / F.lit(w))).cast("int")
    return F.when(x.isNull(), F.lit(bins)).otherwise(b)


def numeric_code(c: str, lo: float, hi: float, bins: int) -> Column:
    return numeric_bin(c, lo, hi, bins).cast("string")


def column_codes(df: DataFrame, nums: list[str], cats: list[str], bounds: dict, bins: int) -> DataFrame:
    out = [numeric_code(c, *bounds[c], bins).alias(c) for c in nums]
    out += [F.coalesce(F.col(c).cast("string"), F.lit(NULL_CODE)).alias(c) for c in cats]
    return df.select(*out)


def marginal_counts(codes: DataFrame, cols: list[str]) -> DataFrame:
    """Exact 1-way (``col_b`` = '') and 2-way (a < b) counts, one job."""
    items = [F.struct(F.lit(a).alias("col_a"), F.lit("").alias("col_b"), F.col(a).alias("va"),
                      F.lit("").alias("vb")) for a in cols]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            items.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).alias("va"),
                                  F.col(b).alias("vb")))
    return (codes.select(F.explode(F.array(*items)).alias("e")).select("e.*")
            .groupBy("col_a", "col_b", "va", "vb").agg(F.count(F.lit(1)).alias("n")))


WIDE_COLUMNS = 16   # above this many columns, count cells with numpy per task


def marginal_counts_wide(codes: DataFrame, cols: list[str], dom: dict) -> DataFrame:
    """Same rows as :func:`marginal_counts` for wide tables: every task
    turns its rows into integer codes and ``np.bincount``s all 1- and 2-way
    cells, emitting only non-zero cells (bounded by the domain sizes); a
    ``groupBy`` adds the tasks up."""
    from synthaudit.functions.shipping import ship_package

    ship_package(codes.sparkSession)
    sizes = [len(dom[c]) for c in cols]
    idx = {c: {v: i for i, v in enumerate(dom[c])} for c in cols}
    p = len(cols)

    def part(batches):
        one = [np.zeros(sizes[i], dtype=np.int64) for i in range(p)]
        two = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack([pdf[c].map(idx[c]).fillna(-1).to_numpy(dtype=np.int64) for c in cols], axis=1)
            ok = (x >= 0).all(axis=1)
            x = x[ok]
            for i in range(p):
                one[i] += np.bincount(x[:, i], minlength=sizes[i])
                for j in range(i + 1, p):
                    cell = np.bincount(x[:, i] * sizes[j] + x[:, j], minlength=sizes[i] * sizes[j])
                    two[(i, j)] = cell if (i, j) not in two else two[(i, j)] + cell
        out = []
        for i in range(p):
            nz = np.nonzero(one[i])[0]
            out.append(pd.DataFrame({"a": i, "b": -1, "va": nz, "vb": 0, "n": one[i][nz]}))
        for (i, j), cell in two.items():
            nz = np.nonzero(cell)[0]
            out.append(pd.DataFrame({"a": i, "b": j, "va": nz // sizes[j], "vb": nz % sizes[j], "n": cell[nz]}))
        if out:
            yield pd.concat(out).astype("int64")

    got = (codes.select(*cols).mapInPandas(part, "a long, b long, va long, vb long, n long")
           .groupBy("a", "b", "va", "vb").agg(F.sum("n").alias("n"))
           .select(*[F.col(c).cast("int").alias(c) for c in ("a", "b", "va", "vb")], "n"))
    names = F.array(*[F.lit(c) for c in cols])
    doms = F.array(*[F.array(*[F.lit(v) for v in dom[c]]) for c in cols])
    pick = lambda col_idx, code: F.element_at(F.element_at(doms, col_idx + 1), code + 1)
    return got.select(
        F.element_at(names, F.col("a") + 1).alias("col_a"),
        F.when(F.col("b") < 0, F.lit("")).otherwise(F.element_at(names, F.col("b") + 1)).alias("col_b"),
        pick(F.col("a"), F.col("va")).alias("va"),
        F.when(F.col("b") < 0, F.lit("")).otherwise(pick(F.col("b"), F.col("vb"))).alias("vb"),
        F.col("n"))


def mutual_information(tab: np.ndarray) -> float:
    tot = tab.sum()
    if tot <= 0:
        return 0.0
    p = tab / tot
    pa, pb = p.sum(axis=1, keepdims=True), p.sum(axis=0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(p > 0, p * np.log(p / (pa * pb)), 0.0)
    return float(np.nansum(t))


def max_spanning_tree(p: int, weight) -> list:
    """Prim from node 0: list of (parent, child) in discovery order."""
    if p == 0:
        return []
    inside, edges = {0}, []
    while len(inside) < p:
        best = None
        for a in inside:
            for b in range(p):
                if b in inside:
                    continue
                w = weight(a, b)
                if best is None or w > best[0]:
                    best = (w, a, b)
        edges.append((best[1], best[2]))
        inside.add(best[2])
    return edges


def laplace(secret: int, stream: str, scale, item: Column) -> Column:
    """Laplace noise of an item, the same whenever it is computed."""
    u = hash_uniform(secret, stream, item) - 0.5
    return -F.signum(u) * F.log1p(-2.0 * F.least(F.abs(u), F.lit(0.5 - 1e-16))) * scale


def _count_cells(batches: Iterator[pa.RecordBatch], pairs: list, sizes: list) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, cell, n) of the non-empty cells; ``b`` -1 is the table of ``a`` alone."""
    dense = {(a, b): np.zeros(sizes[a] * (sizes[b] if b >= 0 else 1), np.int64)
             for a, b in pairs if sizes[a] * (sizes[b] if b >= 0 else 1) <= DENSE_CELLS}

    def rows(a, b, cell, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)) for k in (a, b)]
                                          + [pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))],
                                          names=["a", "b", "cell", "n"])

    for batch in batches:
        codes = [c.to_numpy().astype(np.int64) for c in batch.columns]
        for a, b in pairs:
            cell = codes[a] * sizes[b] + codes[b] if b >= 0 else codes[a]
            if (a, b) in dense:
                dense[a, b] += np.bincount(cell, minlength=len(dense[a, b]))
            else:
                yield rows(a, b, *np.unique(cell, return_counts=True))
    for (a, b), n in dense.items():
        cell = np.flatnonzero(n)
        if len(cell):
            yield rows(a, b, cell, n[cell])


def _n_log_n(n: Column) -> Column:
    return F.sum(F.when(n > 0, n * F.log(n)).otherwise(0.0))


def table_information(cells: DataFrame, sizes: list) -> dict:
    """Mutual information of every pair (a, b) from the cells of its table:
    ``ln t + (sum n ln n - sum over rows - sum over columns) / t``."""
    width = F.element_at(F.array(*[F.lit(k) for k in sizes]), F.col("b") + 1)
    two = cells.where("b >= 0").withColumns({"ia": F.floor(F.col("cell") / width), "ib": F.col("cell") % width})
    sums = {"all": two.groupBy("a", "b").agg(_n_log_n(F.col("n")).alias("s"), F.sum("n").alias("t"))}
    for side in ("ia", "ib"):
        sums[side] = (two.groupBy("a", "b", side).agg(F.sum("n").alias("n"))
                      .groupBy("a", "b").agg(_n_log_n(F.col("n")).alias(side)))
    got = sums["all"].join(sums["ia"], ["a", "b"]).join(sums["ib"], ["a", "b"]).collect()        # one row a pair
    return {(r["a"], r["b"]): max(0.0, math.log(r["t"]) + (r["s"] - r["ia"] - r["ib"]) / r["t"]) if r["t"] > 0 else 0.0
            for r in got}


@register
class DPTree(Synthesizer):
    name = "privbayes"

    def __init__(self, epsilon: float = 1.0, preprocessing_eps: float = 0.1, bins: int = 20,
                 bounds: dict | None = None, noise_seed: int | None = None, delta: float | None = None,
                 min_count: float = 0.0, **kw):
        super().__init__(epsilon=epsilon, preprocessing_eps=preprocessing_eps, bins=bins, **kw)
        if delta is not None:
            self.config["delta"] = delta
        self.bounds_declared, self.delta, self.min_count = dict(bounds or {}), delta, min_count
        self.rng = np.random.default_rng(noise_seed if noise_seed is not None else secrets.randbits(128))

    def _dp_bounds(self, df: DataFrame, cols: list[str], eps: float) -> dict:
        edges = sorted({0.0} | {s * 10.0 ** k for k in GRID_EXP for s in (1.0, -1.0)})
        arr = F.array(*[F.lit(e) for e in edges])
        items = [F.struct(F.lit(c).alias("c"), F.size(F.filter(arr, lambda e: e <= F.col(c).cast("double")))
                          .alias("b")) for c in cols]
        rows = (df.select(F.explode(F.array(*items)).alias("e")).where(F.col("e.b").isNotNull())
                .groupBy("e.c", "e.b").agg(F.count(F.lit(1)).alias("n")).collect())
        e_col = eps / max(1, len(cols))
        out = {}
        for c in cols:
            counts = np.zeros(len(edges) + 1)
            for r in rows:
                if r["c"] == c:
                    counts[int(r["b"])] = r["n"]
            noisy = counts + self.rng.laplace(0.0, 1.0 / e_col, len(counts))
            ok = np.nonzero(noisy > 5.0 / e_col)[0]
            if len(ok) == 0:
                out[c] = (0.0, 1.0)
                continue
            ext = [-(10.0 ** 13)] + edges + [10.0 ** 13]
            out[c] = (ext[ok[0]], ext[ok[-1] + 1])
        return out

    def _secret(self) -> int:
        return int(self.rng.integers(2 ** 62))

    def _fit(self, df: DataFrame, key: str) -> None:
        cfg = self.config
        fields = [f for f in df.schema.fields if f.name != key]
        self.fields = fields
        # dates and timestamps are binned as numbers (epoch days / microseconds)
        self.times = {f.name: f.dataType for f in fields if is_time_type(f.dataType)}
        if self.times:
            df = df.select(key, *[time_to_number(f.name, f.dataType).alias(f.name) if f.name in self.times
                                  else F.col(f.name) for f in fields])
        self.nums = [f.name for f in fields if isinstance(f.dataType, T.NumericType) or f.name in self.times]
        self.cats = [f.name for f in fields if f.name not in self.nums]
        self.cols = self.nums + self.cats
        self.integral = {f.name: isinstance(f.dataType, T.IntegralType) or f.name in self.times for f in fields}
        bins, eps = int(cfg["bins"]), float(cfg["epsilon"])
        declared = {self.standin.get(c, c): b for c, b in self.bounds_declared.items()}
        undeclared = [c for c in self.nums if c not in declared]
        spent = {"preprocessing": 0.0, "values": 0.0, "marginals": 0.0}
        self.bounds = dict(declared)
        if undeclared:
            spent["preprocessing"] = float(cfg["preprocessing_eps"])
            self.bounds.update(self._dp_bounds(df, undeclared, spent["preprocessing"]))
        left = max(eps - spent["preprocessing"], 1e-6)
        if self.delta is not None and self.cats:
            spent["domains"] = DOMAIN_SHARE * left
            left -= spent["domains"]
        texts = self._domains(df, spent, left)
        left -= spent["values"]
        spent["marginals"] = left
        cfg["epsilon_spent"] = spent

        sizes = self.sizes = [bins + 1] * len(self.nums) + [texts[c] for c in self.cats]
        p = len(self.cols)
        pairs = [(a, -1) for a in range(p)] + [(a, b) for a in range(p) for b in range(a + 1, p)]
        counts = self._codes(df, bins).mapInArrow(lambda it: _count_cells(it, pairs, sizes), "a int, b int, cell long, n long")
        counts = counts.groupBy("a", "b", "cell").agg(F.sum("n").alias("n"))
        e1, e2 = left / 3.0 / max(1, p), 2.0 * left / 3.0 / max(1, p * (p - 1) // 2)
        grid = self.spark.createDataFrame(
            [(a, b, sizes[a] * (sizes[b] if b >= 0 else 1), 1.0 / (e1 if b < 0 else e2)) for a, b in pairs],
            "a int, b int, cells long, scale double").repartition(len(pairs), "a", "b")
        grid = grid.select("a", "b", "scale", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
        noise = laplace(self._secret(), "dptree-cell", F.col("scale"), F.concat_ws("|", "a", "b", "cell"))
        cells = grid.join(counts, ["a", "b", "cell"], "left").select(
            "a", "b", "cell", F.greatest(F.lit(0.0), F.coalesce("n", F.lit(0)) + noise).alias("n"))
        self.cells = cut_lineage(cells)
        mi = table_information(self.cells, sizes)
        self.mi = {(self.cols[a], self.cols[b]): v for (a, b), v in mi.items()}
        tree = max_spanning_tree(p, lambda x, y: mi[min(x, y), max(x, y)])
        self.edges = [(self.cols[x], self.cols[y]) for x, y in tree]
        self.shares = self._conditional(tree)

    def _domains(self, df: DataFrame, spent: dict, left: float) -> dict:
        """The codes of the text columns, as a table ``self.domain`` (column,
        code, value); returns how many each column has."""
        self.spread, self.domain = {}, None
        if not self.cats:
            return {}
        each = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(NULL_CODE)).alias("v"))
                         for c in self.cats])
        cnt = df.select(F.explode(each).alias("e")).groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n")).persist()
        values, empty = cnt.where(F.col("v") != NULL_CODE), cnt.where(F.col("v") == NULL_CODE).select("c", "v")
        if self.delta is not None:
            e, d = spent["domains"] / len(self.cats), self.delta / len(self.cats)
            # a count of one passes with probability d
            self.threshold = max(1.0 + max(0.0, math.log(0.5 / d)) / e, self.min_count)
            noise = laplace(self._secret(), "dptree-domain", 1.0 / e, F.concat_ws("|", "c", "v"))
            values = cut_lineage(values.where(F.col("n") + noise >= self.threshold))
            empty = self.spark.createDataFrame([(c, v) for c in self.cats for v in (NULL_CODE, OTHER)], "c string, v string")
        sizes = {r["c"]: r["count"] for r in values.groupBy("c").count().collect()}
        wide = [c for c in self.cats if sizes.get(c, 0) > MAX_DOMAIN]
        own = values.where(~F.col("c").isin(wide)).select("c", "v").unionByName(empty)
        if wide:
            spent["values"] = VALUE_SHARE * left
        for c in wide:
            noise = laplace(self._secret(), f"dptree-noise|{c}", len(wide) / spent["values"], F.col("v"))
            # a published value keeps a positive share, whatever its noise
            self.spread[c] = Spread(values.where(F.col("c") == c).select(
                "v", F.greatest(F.col("n") + noise, F.lit(1e-3)).alias("n")), MAX_DOMAIN, sizes[c])
            codes = self.spread[c].values.select(F.lit(c).alias("c"), F.col("code").alias("v")).distinct()
            own = own.unionByName(codes)
        # at most MAX_DOMAIN + 2 codes a column
        number = F.row_number().over(Window.partitionBy("c").orderBy("v")) - 1
        self.domain = cut_lineage(own.distinct().select("c", number.alias("code"), "v"))
        self.released = None if self.delta is None else values.select("c", "v")
        cnt.unpersist()
        got = {r["c"]: r["count"] for r in self.domain.groupBy("c").count().collect()}               # one row a column
        return {c: got.get(c, 0) for c in self.cats}

    def _domain_of(self, c: str, code: str, value: str) -> DataFrame:
        return F.broadcast(self.domain.where(F.col("c") == c).select(F.col("code").alias(code), F.col("v").alias(value)))

    def _codes(self, df: DataFrame, bins: int) -> DataFrame:
        """The rows as numbers, one column ``c<j>`` for each column."""
        rows = df.select(*[numeric_bin(c, *self.bounds[c], bins).alias(f"c{j}") for j, c in enumerate(self.nums)],
                         *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_CODE)).alias(f"v{j}")
                           for j, c in enumerate(self.cats, len(self.nums))])
        for j, c in enumerate(self.cats, len(self.nums)):
            value = F.col(f"v{j}")
            if self.released is not None:
                # only the values that are released are told apart
                known = self.released.where(F.col("c") == c).select(F.col("v").alias("__known"))
                rows = rows.join(known, value == F.col("__known"), "left").withColumn(
                    f"v{j}", F.when(F.col("__known").isNotNull() | (value == NULL_CODE), value).otherwise(OTHER)).drop("__known")
            if c in self.spread:
                rows = rows.withColumn(f"v{j}", F.when(value.isin(NULL_CODE, OTHER), value).otherwise(
                    shared_code(value, MAX_DOMAIN)))
            rows = rows.join(self._domain_of(c, f"c{j}", f"__v{j}"), F.col(f"v{j}") == F.col(f"__v{j}")).drop(f"__v{j}", f"v{j}")
        return rows.select(*[F.col(f"c{j}").cast("long") for j in range(len(self.cols))])

    def counts(self) -> DataFrame:
        """The noisy 1-way counts: ``col_a``, ``code`` (bin or text value) and ``n``."""
        names = F.element_at(F.array(*[F.lit(c) for c in self.cols]), F.col("a") + 1)
        one = self.cells.where("b < 0").select(names.alias("col_a"), F.col("cell").alias("number"), "n")
        if self.domain is None:
            return one.select("col_a", F.col("number").cast("string").alias("code"), "n")
        text = self.domain.select(F.col("c").alias("col_a"), F.col("code").cast("long").alias("number"), "v")
        return one.join(text, ["col_a", "number"], "left").select(
            "col_a", F.coalesce("v", F.col("number").cast("string")).alias("code"), "n")

    def _conditional(self, tree: list) -> DataFrame:
        """Intervals [lo, hi) of a child's codes by its parent's code (root: 0),
        laid out in as many cells of [0, 1) as the child has codes."""
        sizes = self.sizes
        one = self.cells.where("b < 0").select(F.col("a").alias("child"), F.col("cell").alias("code"), F.col("n").alias("alone"))
        root = one.where(F.col("child") == 0).select("child", F.lit(0).cast("long").alias("parent_code"), "code",
                                                     F.lit(0.0).alias("n"))
        rows = root
        if tree:
            edges = self.spark.createDataFrame([(min(e), max(e), e[1], sizes[max(e)]) for e in tree],
                                               "a int, b int, child int, width long")
            two = self.cells.join(F.broadcast(edges), ["a", "b"])
            ia, ib, first = F.floor(F.col("cell") / F.col("width")), F.col("cell") % F.col("width"), F.col("child") == F.col("a")
            rows = rows.unionByName(two.select("child", F.when(first, ib).otherwise(ia).alias("parent_code"),
                                               F.when(first, ia).otherwise(ib).alias("code"), "n"))
        # every window below holds the codes of one (child, parent code): at most MAX_DOMAIN + 2
        group = Window.partitionBy("child", "parent_code")
        rows = rows.join(one, ["child", "code"])
        weight = (F.when(F.sum("n").over(group) > 0, F.col("n")).when(F.sum("alone").over(group) > 0, F.col("alone"))
                  .otherwise(F.lit(1.0)))
        rows = rows.select("child", "parent_code", "code", weight.alias("weight")).where("weight > 0")
        order = group.orderBy("code")
        upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(group)
        hi = F.when(F.lead("code").over(order).isNull(), 1.0).otherwise(F.least(upto, F.lit(1.0)))
        rows = rows.select("child", "parent_code", "code", hi.alias("hi"))
        rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
        width = F.element_at(F.array(*[F.lit(k) for k in sizes]), F.col("child") + 1)
        cell = F.explode(F.sequence(F.floor(F.col("lo") * width), F.least(F.floor(F.col("hi") * width), (width - 1).cast("long"))))
        return cut_lineage(rows.select("child", "parent_code", "code", "lo", "hi", cell.alias("cell")))

    def _sample(self, n: int, seed: int) -> DataFrame:
        key, bins, place = self.key, int(self.config["bins"]), {c: j for j, c in enumerate(self.cols)}
        parent = {place[ch]: place[par] for par, ch in self.edges}
        order = [0] + [place[ch] for _, ch in self.edges]
        # the draws as one array: written out between the joins, they make the sample half as slow again (measured)
        streams = [f"dptree|{self.cols[j]}" for j in order] + [f"dptree-bin|{c}" for c in self.nums]
        draws = F.transform(F.array(*[F.lit(s) for s in streams]), lambda s: hash_uniform(seed, s, F.col("id")))
        rows = sample_ids(self.spark, n).select(F.col("id").alias(key), draws.alias("__draws"))
        for k, j in enumerate(order):
            own = self.shares.where(F.col("child") == j).select("parent_code", "cell", "lo", "hi", F.col("code").alias(f"c{j}"))
            if self.sizes[j] * (self.sizes[parent[j]] if j in parent else 1) <= SMALL_TABLE:
                own = F.broadcast(own)
            rows = rows.withColumn("__u", F.col("__draws")[k])
            given = F.col(f"c{parent[j]}") if j in parent else F.lit(0).cast("long")
            rows = rows.join(own, (given == F.col("parent_code")) & (F.floor(F.col("__u") * self.sizes[j]) == F.col("cell"))
                             & (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi"))).drop("parent_code", "cell", "lo", "hi", "__u")
            if k % JOINS_A_STEP == JOINS_A_STEP - 1:
                rows = cut_lineage(rows)
        for c in self.cats:
            rows = rows.join(self._domain_of(c, "__code", f"__t{place[c]}"), F.col(f"c{place[c]}") == F.col("__code")).drop("__code")
        out = []
        for i, c in enumerate(self.nums, len(order)):
            lo, hi = self.bounds[c]
            w = (hi - lo) / bins if hi > lo else 0.0
            x = F.lit(float(lo)) + (F.col(f"c{place[c]}") + F.col("__draws")[i]) * F.lit(float(w))
            x = F.rint(x) if self.integral[c] else x
            out.append(F.when(F.col(f"c{place[c]}") < bins, x).alias(c))
        out += [F.nullif(F.col(f"__t{place[c]}"), F.lit(NULL_CODE)).alias(c) for c in self.cats]
        raw = rows.select(key, *out)
        for c, spread in self.spread.items():       # a shared code draws one of its values
            drawn = spread.draw(raw.withColumn("__own", F.col(c)), c, hash_uniform(seed, f"dptree-value|{c}", F.col(key)))
            raw = drawn.withColumn(c, F.when(F.col("__own") == OTHER, F.lit(OTHER)).otherwise(F.col(c))).drop("__own")
        times = self.times
        return raw.select(F.col(key), *[number_to_time(f.name, f.dataType).alias(f.name) if f.name in times
                                        else F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields])


REGISTRY["dptree"] = DPTree      # the name of the default configuration
