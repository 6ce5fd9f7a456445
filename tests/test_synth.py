"""Synthesizers (N1–N4) and the utility of what they produce."""

import numpy as np
import pytest

from synthaudit.operators import logic, stats
from synthaudit.operators.synth import NotAvailable, build
from synthaudit.operators.synth.dptree import max_spanning_tree, mutual_information
from synthaudit.plans import fixtures as fx
from synthaudit.plans.q_synth import BOUNDS


@pytest.fixture(scope="module")
def train(spark):
    t, _c = fx.split(spark, "/root/testdata/sf0.01")
    return t.cache()


def test_registry():
    with pytest.raises(ValueError):
        build("nope")
    with pytest.raises(NotAvailable):
        build("CT-GAN")
    assert build("Priv_Bayes").name == "privbayes"


def test_sample_before_fit():
    with pytest.raises(RuntimeError):
        build("copula").sample(10)


def test_copula_fidelity(spark, train):
    m = build("copula").fit(train, "row_key")
    syn = m.sample(train.count(), seed=42).cache()
    assert syn.count() == train.count()
    sim = stats.correlation_similarity(train, syn, "row_key").first()[0]
    assert sim >= 0.98
    lg = logic.logic_score(logic.logic_check(train, syn, "row_key")).first()
    assert lg["n_violations"] == 0
    assert m.fit_seconds is not None and m.sample_seconds is not None


def test_copula_sample_partition_independent(spark, train):
    m = build("copula").fit(train, "row_key")
    a = m.sample(500, seed=7).orderBy("row_key").collect()
    b = m.sample(500, seed=7).repartition(3).orderBy("row_key").collect()
    assert a == b


def test_dptree(spark, train):
    m = build("privbayes", bounds=BOUNDS, noise_seed=1).fit(train, "row_key")
    assert len(m.edges) == len(m.cols) - 1
    syn = m.sample(2000, seed=1)
    assert syn.count() == 2000
    assert set(syn.columns) == set(train.columns)
    assert m.config["epsilon_spent"]["preprocessing"] == 0.0   # bounds declared


def test_dptree_spends_preprocessing_budget(spark, train):
    m = build("privbayes", noise_seed=2).fit(train, "row_key")
    assert m.config["epsilon_spent"]["preprocessing"] == pytest.approx(0.1)


def test_mst_and_mi():
    w = {(0, 1): 5.0, (0, 2): 1.0, (1, 2): 3.0}
    edges = max_spanning_tree(3, lambda a, b: w[(min(a, b), max(a, b))])
    assert edges == [(0, 1), (1, 2)]
    assert mutual_information(np.array([[10.0, 0.0], [0.0, 10.0]])) == pytest.approx(np.log(2))
    assert mutual_information(np.array([[5.0, 5.0], [5.0, 5.0]])) == pytest.approx(0.0)


def test_wide_marginals_equal_explode_path(spark, train):
    from pyspark.sql import functions as F

    from synthaudit.operators.synth.dptree import NULL_CODE, column_codes, marginal_counts, marginal_counts_wide

    nums = ["o_totalprice", "c_acctbal", "n_lines", "sum_qty", "sum_price"]
    cats = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
    src = train.withColumn("c_acctbal", F.when(F.col("row_key") % 9 == 0, None).otherwise(F.col("c_acctbal")))
    codes = column_codes(src, nums, cats, BOUNDS, 20)
    dom = {c: [str(i) for i in range(21)] for c in nums}
    for c in cats:
        dom[c] = sorted(r[0] for r in codes.select(c).distinct().collect())
    a = sorted(map(tuple, marginal_counts(codes, nums + cats).collect()))
    b = sorted(map(tuple, marginal_counts_wide(codes, nums + cats, dom).collect()))
    assert a == b and len(a) > 100


def test_generators_model_datetimes(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), dt.date(2024, 1, 1) + dt.timedelta(days=i % 40), float(i % 13),
             "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, d date, x double, s string")
    for name, kw in (("copula", {}), ("privbayes", {"noise_seed": 3})):
        syn = build(name, **kw).fit(df, "k").sample(300, seed=1)
        assert dict(syn.dtypes) == dict(df.dtypes)
        r = syn.agg({"ts": "min", "d": "max"}).first()
        assert r[0] is not None and r[1] is not None
    cop = build("copula").fit(df, "k").sample(300, seed=1)
    lo, hi = cop.agg({"ts": "min"}).first()[0], cop.agg({"ts": "max"}).first()[0]
    assert base <= lo and hi <= base + dt.timedelta(minutes=7 * 399)


def test_dptree_many_values(spark):
    """Shared codes: every draw finds a value, frequent values stay frequent, and the budget is split."""
    df = spark.range(40_000).selectExpr(
        "id AS row_key", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 11 = 0 THEN NULL ELSE concat('v', id % 5000) END AS word",
        "CAST(id % 7 AS double) AS x")
    m = build("privbayes", epsilon=1000.0, bounds={"x": (0.0, 7.0)}, noise_seed=3).fit(df, "row_key")
    spent = m.config["epsilon_spent"]
    assert spent["values"] > 0 and abs(sum(spent.values()) - 1000.0) < 1e-9
    syn = m.sample(20_000, seed=5)
    known = {r["word"] for r in df.select("word").distinct().collect()}
    counts = {r["word"]: r["count"] for r in syn.groupBy("word").count().collect()}
    assert set(counts) <= known and sum(counts.values()) == 20_000
    assert abs(counts["hot"] / 20_000 - 1 / 3) < 0.02
    assert abs(counts[None] / 20_000 - 2 / 33) < 0.02
    assert len(counts) > 2_000


def test_copula_many_values(spark, monkeypatch):
    """More categories than codes: nothing is refused, lost or made up."""
    from synthaudit.operators.synth import copula

    monkeypatch.setattr(copula, "MAX_CATEGORIES", 50)
    df = spark.range(30_000).selectExpr(
        "id AS row_key", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 11 = 0 THEN NULL ELSE concat('v', id % 500) END AS `odd-word`",
        "CAST(id % 7 AS double) AS x", "IF(id % 2 = 0, 'a', 'b') AS few")
    syn = build("copula").fit(df, "row_key").sample(20_000, seed=5)
    known = {r[0] for r in df.select("`odd-word`").distinct().collect()}
    counts = {r[0]: r[1] for r in syn.groupBy("`odd-word`").count().collect()}
    assert set(counts) <= known and len(counts) > 0.9 * len(known) and sum(counts.values()) == 20_000
    assert abs(counts["hot"] / 20_000 - 1 / 3) < 0.02 and abs(counts[None] / 20_000 - 2 / 33) < 0.02
    assert {r["few"] for r in syn.select("few").distinct().collect()} == {"a", "b"}


def test_dptree_private_domains(spark):
    """Rare values are never released and share one code, paid from the budget."""
    df = spark.range(30_000).selectExpr(
        "id AS row_key", "CASE WHEN id % 500 = 0 THEN concat('rare', id) WHEN id % 11 = 0 THEN NULL ELSE concat('v', id % 9) END AS word",
        "IF(id % 2 = 0, 'a', concat('own', id)) AS half", "CAST(id % 7 AS double) AS x")
    m = build("privbayes", epsilon=8.0, delta=1e-6, bounds={"x": (0.0, 7.0)}, noise_seed=4).fit(df, "row_key")
    spent = m.config["epsilon_spent"]
    assert spent["domains"] == pytest.approx(0.8) and sum(spent.values()) == pytest.approx(8.0) and m.config["delta"] == 1e-6
    assert m.threshold > 30
    syn = m.sample(20_000, seed=5)
    words = {r["word"]: r["count"] for r in syn.groupBy("word").count().collect()}
    assert set(words) == {None, "(other)"} | {f"v{k}" for k in range(9)}
    assert words["(other)"] < 0.02 * 20_000
    halves = {r["half"]: r["count"] for r in syn.groupBy("half").count().collect()}
    assert set(halves) <= {"a", "(other)", None} and abs(halves["(other)"] / 20_000 - 0.5) < 0.03


def test_dptree_information_and_shares(spark):
    """Information by aggregates equals the one of the whole tables; the shares of a parent's code cover [0, 1)."""
    from synthaudit.operators.synth.dptree import table_information

    df = spark.range(5000).selectExpr("id AS k", "CAST(id % 5 AS string) AS a", "CAST(id % 5 + id % 2 AS string) AS b",
                                      "CAST(id % 17 AS double) AS x")
    m = build("privbayes", epsilon=1e9, bounds={"x": (0.0, 17.0)}, noise_seed=1, bins=17).fit(df, "k")
    cells = {(r.a, r.b, r.cell): r.n for r in m.cells.collect()}
    for (a, b), v in table_information(m.cells, m.sizes).items():
        tab = np.array([[cells[a, b, i * m.sizes[b] + j] for j in range(m.sizes[b])] for i in range(m.sizes[a])])
        assert v == pytest.approx(mutual_information(tab), abs=1e-9)
    spans = {}
    for r in m.shares.select("child", "parent_code", "code", "lo", "hi").distinct().collect():
        spans.setdefault((r.child, r.parent_code), []).append((r.lo, r.hi))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] == 1 and all(x[1] == y[0] for x, y in zip(s, s[1:]))
