"""Attacks, nearest search, sampling: properties and brute force checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthaudit.operators import cmla as cm
from synthaudit.operators import linkability as lk
from synthaudit.operators import sampling as sp
from synthaudit.operators import singling_out as so
from synthaudit.operators.nearest import ColSpec, Metric, nearest
from synthaudit.plans import fixtures as fx


@pytest.fixture(scope="module")
def three(spark, sf):
    train, syn, ctl = fx.three_way(spark, sf)
    return train.cache(), syn.cache(), ctl.cache()


def test_split_exact_and_disjoint(spark, sf):
    facts = fx.cached_facts(spark, sf)
    n = facts.count()
    train, ctl = sp.train_control_split(facts, "row_key", 0.5, 42)
    a = {r.row_key for r in train.collect()}
    b = {r.row_key for r in ctl.collect()}
    assert len(a) == n // 2 and not (a & b) and len(a | b) == n


def test_split_histogram_levels_equal_topk(spark, sf):
    facts = fx.cached_facts(spark, sf)
    old = sp.FINAL_BUCKET_ROWS, sp.TOPK_LIMIT
    sp.FINAL_BUCKET_ROWS, sp.TOPK_LIMIT = 3, 0
    try:
        via_hist = {r.row_key for r in sp.first_n(facts.repartition(5), "row_key", 300).collect()}
    finally:
        sp.FINAL_BUCKET_ROWS, sp.TOPK_LIMIT = old
    via_topk = {r.row_key for r in sp.first_n(facts, "row_key", 300).collect()}
    assert via_hist == via_topk and len(via_topk) == 300


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    cand = pd.DataFrame({"k": np.arange(300), "x": rng.integers(0, 5, 300).astype(float),
                         "y": rng.normal(size=300), "s": rng.choice(["a", "b", None], 300)})
    cand.loc[5, "x"] = np.nan
    q = cand.sample(20, random_state=1).reset_index(drop=True)
    cdf = spark.createDataFrame(cand).repartition(4)
    m = [Metric("g", (ColSpec("x", "num", 4.0), ColSpec("s", "cat"))),
         Metric("e", (ColSpec("x", "sq"), ColSpec("y", "sq")), root=True)]
    got = {r.q_key: r for r in nearest(cdf, "k", q, "k", m, exclude_self=True).collect()}

    def gower(a, b):
        d = 0.0
        if pd.isna(a.x) and pd.isna(b.x):
            d += 0.0
        elif pd.isna(a.x) or pd.isna(b.x):
            d += 1.0
        else:
            d += abs(a.x - b.x) / 4.0
        if a.s is None and b.s is None:
            d += 0.0
        elif a.s is None or b.s is None:
            d += 1.0
        else:
            d += float(a.s != b.s)
        return d

    for _, a in q.iterrows():
        best = min(((gower(a, b), b.k) for _, b in cand.iterrows() if b.k != a.k))
        assert (got[a.k].g_dist, got[a.k].g_key) == pytest.approx(best)


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    from synthaudit.operators import nearest as nn

    rng = np.random.default_rng(1)
    cand = spark.createDataFrame(pd.DataFrame({"k": np.arange(200), "x": rng.normal(size=200), "s": list("ab") * 100}))
    q = pd.DataFrame({"k": np.arange(50), "x": rng.normal(size=50), "s": list("ba") * 25})
    m = [Metric("g", (ColSpec("x", "num", rng.uniform(1, 3, 50)), ColSpec("s", "cat"))),
         Metric("e", (ColSpec("x", "sq"),), root=True)]
    whole = sorted(nearest(cand, "k", q, "k", m, exclude_self=True).collect())
    monkeypatch.setattr(nn, "MAX_QUERIES", 7)
    assert sorted(nearest(cand, "k", q, "k", m, exclude_self=True).collect()) == whole and len(whole) == 50


def test_singling_out_bounds_and_identity(three):
    train, syn, ctl = three
    r = so.singling_out(train, syn, ctl, "row_key", 200)
    assert 0 <= r.ci_lower <= r.risk_score <= r.ci_upper <= 1
    r2 = so.singling_out(train, train, ctl, "row_key", 200)
    assert r2.risk_score >= r.risk_score and r2.n_success >= r.n_success


def test_linkability_copies_raise_risk(three):
    train, syn, ctl = three
    r = lk.linkability(train, syn, ctl, "row_key", 100)
    rc = lk.linkability(train, train, ctl, "row_key", 100)
    assert rc.risk_score > r.risk_score and rc.n_success == 100


def test_linkability_needs_two_halves(spark):
    df = spark.createDataFrame([(1, 1.0)], "row_key long, a double")
    assert lk.linkability(df, df, df, "row_key").notes.startswith("FAILED")


def test_cmla_calibrations(three):
    train, syn, _ctl = three
    lit = cm.cmla(train, syn, "row_key", labels="o_orderstatus", calibration="literal", detail=True)
    oth = cm.cmla(train, syn, "row_key", labels="o_orderstatus", detail=True)
    assert lit["threshold"] == 0.0 and lit["n_leaking"] == 0          # D1: literal is degenerate
    assert oth["threshold"] > 0.0
    copy = cm.cmla(train, train, "row_key", labels="o_orderstatus", detail=True)
    assert copy["n_leaking"] >= copy["k"]                              # every medoid is copied


def test_cmla_many_clusters(three, monkeypatch):
    train, syn, _ctl = three
    few = cm.cmla(train, syn, "row_key", labels="n_lines", detail=True)
    monkeypatch.setattr(cm, "MAX_CLUSTERS", 2)
    many = cm.cmla(train, syn, "row_key", labels="n_lines", detail=True)
    assert many["k"] == few["k"] > 2 and many["n_leaking"] == few["n_leaking"]
    a, b = ({r.row_key: r.dist for r in x["distances"].collect()} for x in (few, many))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_kmeans_says_when_it_has_not_converged(three):
    train, syn, _ctl = three
    ref = cm.fit_reference(train, "row_key", 5, kmeans_max_iter=1, kmeans_tol=0.0)
    assert "not converged in 1 rounds" in cm.score(ref, syn, "row_key").notes
    assert cm.fit_reference(train, "row_key", 5, kmeans_max_iter=200).remark == ""


def test_cmla_missing_column_fails(three):
    train, syn, _ctl = three
    r = cm.cmla(train, syn.drop("sum_qty"), "row_key")
    assert r.risk_score == 1.0 and r.notes.startswith("FAILED")


def test_kmeans_partition_independent(three):
    from synthaudit.operators import kmeans

    train, _syn, _ctl = three
    zr, _zs, cols = cm.scaled(train, train, "row_key")
    a = kmeans.fit(zr, "row_key", cols, 4, 42)
    b = kmeans.fit(zr.repartition(7), "row_key", cols, 4, 42)
    assert np.allclose(a, b, atol=1e-9)


def test_topk_choice_equals_full_counts(three):
    train, syn, _ctl = three
    cols = [c for c in train.columns if c != "row_key"]
    old = so.TOPK_START
    so.TOPK_START = 1                        # force the pool to grow
    try:
        a = sorted(map(tuple, so.choose_topk(syn, "row_key", cols, 300).collect()))
    finally:
        so.TOPK_START = old
    b = sorted(map(tuple, so.choose(so.predicates(syn, "row_key", cols), 300).collect()))
    assert a == b and len(a) == 300


def test_first_n_prefilter_equals_topk(spark, sf):
    facts = fx.cached_facts(spark, sf)
    n = facts.count()
    old = sp.SMALL_TABLE
    sp.SMALL_TABLE = 10                      # force the hash-prefix path
    try:
        a = {r.row_key for r in sp.first_n(facts, "row_key", 50, n_rows=n).collect()}
    finally:
        sp.SMALL_TABLE = old
    b = {r.row_key for r in sp.first_n(facts, "row_key", 50).collect()}
    assert a == b and len(a) == 50


def test_topk_pool_with_prefilter(three):
    train, syn, _ctl = three
    cols = [c for c in train.columns if c != "row_key"]
    a = sorted(map(tuple, so.choose_topk(syn, "row_key", cols, 100, n_rows=syn.count()).collect()))
    b = sorted(map(tuple, so.choose(so.predicates(syn, "row_key", cols), 100).collect()))
    assert a == b


def test_topk_pool_prefilter_widens(three):
    train, syn, _ctl = three
    cols = [c for c in train.columns if c != "row_key"]
    # an overstated row count starts from a far too narrow prefix, which must widen
    a = sorted(map(tuple, so.choose_topk(syn, "row_key", cols, 100, n_rows=10_000_000).collect()))
    b = sorted(map(tuple, so.choose(so.predicates(syn, "row_key", cols), 100).collect()))
    assert a == b


def test_topk_leaves_repeated_values_to_the_full_count(spark, monkeypatch):
    """Few values occur once: no pool that grows to hundreds of thousands of rows of the driver."""
    syn = spark.range(40_000).selectExpr("id AS row_key", "CAST(id % 900 AS DOUBLE) AS x", "CAST(least(id, 20) AS DOUBLE) AS y")
    pools, make = [], type(spark).createDataFrame

    def counted(self, data, *args, **kw):
        pools.append(len(data) if isinstance(data, list) else 0)
        return make(self, data, *args, **kw)

    monkeypatch.setattr(type(spark), "createDataFrame", counted)
    a = sorted(map(tuple, so.choose_topk(syn, "row_key", ["x", "y"], 100, n_rows=40_000).collect()))
    assert max(pools) <= 400 and len(a) == 21       # y 0 to 19 and the least y
    assert a == sorted(map(tuple, so.choose(so.predicates(syn, "row_key", ["x", "y"]), 100).collect()))


def test_predicates_count_the_values_once(spark):
    syn = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 2.0, None), (4, 5.0, "b")], "row_key long, x double, s string")
    p = so.predicates(syn, "row_key", ["x", "s"])
    assert sorted((r.column_name, r.kind, r.syn_key) for r in p.collect()) == [
        ("s", "eq", 1), ("s", "null", 3), ("x", "eq", 1), ("x", "eq", 4), ("x", "ge", 4), ("x", "le", 1)]
    assert p._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_nearest_holds_few_cells_at_once():
    import tracemalloc

    from synthaudit.operators import nearest as nn

    q = pd.DataFrame({"k": np.arange(1000), "x": np.arange(1000.0)})
    rng, held = np.random.default_rng(1), []
    for n in (2_000, 20_000):
        c = pd.DataFrame({"k": np.arange(n), "x": np.where(np.arange(n) % 9 == 0, np.nan, rng.normal(size=n))})
        m = Metric("g", (ColSpec("x", "num", 4.0),))
        step = max(1, nn.MAX_CELLS // len(q))
        cdata = nn._candidate_columns(c, [m], {})
        tracemalloc.start()
        for i in range(0, n, step):
            nn._distances(m, {"x": q.x.to_numpy()}, cdata, slice(i, i + step))
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert held[1] < 20e6 and held[1] < 1.5 * held[0]
