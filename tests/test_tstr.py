"""Labels and levels as numbered tables, fully grown forests, isolation of failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthaudit.config import AuditConfig
from synthaudit.operators import forest as fo
from synthaudit.operators import tstr as ts
from synthaudit.operators.encode import category_levels, label_classes, sparse_entries, wide_design
from synthaudit.operators.forest import forest_votes, grow, predicted
from synthaudit.plans import audit as au
from synthaudit.plans import fixtures as fx


def _rows(n, seed=0, levels=9):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n)], axis=1).astype(float)
    g = np.stack([rng.integers(0, levels + 1, n), np.where((c := rng.integers(0, 3, n)) > 0, c + levels, 0)], axis=1)
    return x, g, rng


# ------------------------------------------------------------------ trees
def test_full_trees_fit_distinct_rows():
    x, g, rng = _rows(3000)
    y = rng.integers(0, 7, 3000)
    tree = grow(x, g, y, np.ones(3000), 11, seed=4)
    label = dict(zip(tree.leaf.tolist(), tree.label.tolist()))
    assert (tree.share == 1).all() and [label[k] for k in tree.leaves(x, g).tolist()] == y.tolist()
    again = grow(x, g, y, np.ones(3000), 11, seed=4)
    assert again.pack() == tree.pack() != grow(x, g, y, np.ones(3000), 11, seed=5).pack()
    shallow = grow(x, g, y, np.ones(3000), 11, seed=4, depth=3)
    assert (shallow.feature >= 0).sum() <= 7
    assert np.allclose(np.bincount(shallow.leaf, shallow.share)[np.unique(shallow.leaf)], 1)
    kept = fo.Tree.unpack({k: np.asarray(v) for k, v in tree.pack().items()})
    assert (kept.leaves(x, g) == tree.leaves(x, g)).all()


def test_rows_that_no_feature_tells_apart():
    x, g = np.zeros((4, 1)), np.zeros((4, 1), int)
    tree = grow(x, g, np.array([2, 0, 2, 2]), np.array([1, 1, 1, 2]), 0, seed=1)
    assert tree.feature.tolist() == [-1] and dict(zip(tree.label, tree.share)) == {0: 0.2, 2: 0.8}
    odd = np.array([[-np.inf], [np.inf], [1.0], [np.nextafter(1.0, 2)]])
    tree = grow(odd, np.zeros((4, 0), int), np.array([0, 1, 2, 3]), np.ones(4), 0, seed=1)
    assert len(set(tree.leaves(odd, np.zeros((4, 0), int)).tolist())) == 4


def _gini_cut(values, y, w):
    """The best cut of one feature by trying all."""
    best = None
    for cut in np.unique(values)[:-1]:
        score = sum((np.bincount(y[s], w[s]) ** 2).sum() / w[s].sum() for s in (values <= cut, values > cut))
        if best is None or score > best[0] + 1e-9:
            best = (score, cut)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_root_split_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 30, 200).astype(float)
    y = ((v > 11) + rng.integers(0, 2, 200)).astype(int)
    w = rng.integers(1, 4, 200).astype(float)
    tree = grow(v[:, None], np.zeros((200, 0), int), y, w, 0, seed, depth=1)
    score, cut = _gini_cut(v, y, w)
    side = v > tree.threshold[0]
    assert (side == (v > cut)).all()
    g = rng.integers(0, 2, 200)                 # a single dummy
    tree = grow(np.zeros((200, 0)), g[:, None], np.where(g > 0, y, 0), w, 1, seed, depth=1)
    assert tree.feature[0] == 0 and set(tree.leaves(np.zeros((200, 0)), g[:, None])[g == 1]) == {tree.right[0]}


# ------------------------------------------------------------------ forests on Spark
def _frames(spark, n, seed=0, noise=0.0):
    x, g, rng = _rows(n, seed)
    y = (x[:, 0] > 0).astype(int) * 2 + (g[:, 0] == 3)
    y = np.where(rng.random(n) < noise, rng.integers(0, 4, n), y)
    rows = [([0, 1], i, x[i].tolist(), g[i].tolist(), int(y[i])) for i in range(n)]
    schema = "forests array<long>, id long, numbers array<double>, levels array<int>, label long"
    return spark.createDataFrame(rows, schema).repartition(5), y


def _accuracy(votes, y):
    got = {(r.forest, r.id): r.prediction for r in predicted(votes).collect()}
    assert set(got) == {(f, i) for f in (0, 1) for i in range(len(y))}
    return np.mean([got[(f, i)] == y[i] for f in (0, 1) for i in range(len(y))])


def test_forest_and_its_parts(spark):
    df, y = _frames(spark, 1500)
    votes = forest_votes(df, df, 2, 2, 11, trees=9)
    assert _accuracy(votes, y) > 0.99
    total = votes.groupBy("forest", "id").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(9) for r in total)
    key = lambda v: sorted((r.forest, r.id, r.label, round(r.share, 9)) for r in v.collect())       # noqa: E731
    assert key(votes) == key(forest_votes(df.repartition(11), df.repartition(2), 2, 2, 11, trees=9))
    assert key(votes) == key(forest_votes(df, df, 2, 2, 11, trees=9, rows_at_once=3000 * 4))      # trees in batches


def test_oversized_nodes_are_split_on_samples(spark):
    df, y = _frames(spark, 4000, noise=0.05)
    whole = _accuracy(forest_votes(df, df, 2, 2, 11, trees=7), y)
    parts = forest_votes(df, df, 2, 2, 11, trees=7, group_rows=300)
    total = parts.groupBy("forest", "id").agg(F.sum("share").alias("s")).collect()
    assert len(total) == 8000 and all(r.s == pytest.approx(7) for r in total)
    assert abs(_accuracy(parts, y) - whole) < 0.02
    # nothing to split on, or nothing to split: leaves with the shares of all rows
    flat = df.withColumns({"numbers": F.array(F.lit(0.0), F.lit(0.0)), "levels": F.array(F.lit(0), F.lit(0))})
    share = forest_votes(flat, flat, 2, 2, 11, trees=3, group_rows=300).where("forest = 0 AND id = 0").collect()
    assert sum(r.share for r in share) == pytest.approx(3)
    assert {r.label: r.share / 3 for r in share}[0] == pytest.approx((y == 0).mean(), abs=0.05)
    pure = df.withColumn("label", F.lit(6).cast("long"))
    assert {(r.label, r.share) for r in forest_votes(pure, pure, 2, 2, 11, trees=3, group_rows=300).collect()} == {(6, 3.0)}


def test_large_nodes_are_split_on_all_rows(spark, monkeypatch):
    """Trees do not depend on the size of groups: no split comes from a sample, no large node is given up."""
    df, y = _frames(spark, 2000, noise=0.3)
    df = df.withColumns({
        "numbers": F.array(F.col("numbers")[0], F.col("numbers")[1], F.when(F.col("id") % 5 == 0, -0.0).otherwise(0.0),
                           F.when(F.col("id") < 800, F.lit(float("inf"))).otherwise(F.floor(F.col("id") / 400).cast("double"))),
        "forests": F.when(F.col("id") % 4 == 0, F.array(F.lit(1).cast("long"))).otherwise(F.col("forests")),
        "label": F.when(F.col("id") % 11 == 0, 40 + F.col("id") % 7).otherwise(F.col("label"))})
    key = lambda v: sorted((r.forest, r.id, r.label, round(r.share, 9)) for r in v.collect())       # noqa: E731
    whole = key(forest_votes(df, df, 4, 2, 11, trees=2))
    assert whole == key(forest_votes(df, df, 4, 2, 11, trees=2, group_rows=250))
    monkeypatch.setattr(fo, "SMALL_FOREST", 0)             # rows whole in the tasks, then sent to the subtrees
    assert whole == key(forest_votes(df, df, 4, 2, 11, trees=2))
    shallow = key(forest_votes(df, df, 4, 2, 11, trees=2, depth=2))
    assert shallow == key(forest_votes(df, df, 4, 2, 11, trees=2, depth=2, group_rows=250)) != whole
    # dummies only, many of them in every row of a node: the one feature that still splits is found
    flat = df.withColumns({"numbers": F.array().cast("array<double>"), "levels": F.array(
        (1 + F.col("id") % 2).cast("int"), F.when(F.col("id") % 40 < 39, F.lit(9)).otherwise(11).cast("int"))})
    assert key(forest_votes(flat, flat, 0, 2, 11, trees=2)) == key(forest_votes(flat, flat, 0, 2, 11, trees=2, group_rows=2))


def test_equal_rows_are_one_in_a_group():
    x, g, rng = _rows(400)
    x, g, y = np.repeat(x.round(), 5, axis=0), np.repeat(g, 5, axis=0), np.repeat(rng.integers(0, 3, 400), 5)
    x[::7] *= -1.0                              # also -0.0
    order, start = fo._alike(x, g, y)
    rows = [tuple(v) for v in np.column_stack([x + 0.0, g, y])]
    assert len(start) == len(set(rows)) and sorted(order.tolist()) == list(range(2000))
    w = rng.integers(1, 4, 2000)
    whole = grow(x, g, y, w, 11, seed=3)
    one = grow(x[order[start]], g[order[start]], y[order[start]], np.add.reduceat(w[order], start), 11, seed=3)
    assert one.pack() == whole.pack()
    assert fo._alike(np.arange(10.0)[:, None], np.zeros((10, 0), int)) is None


# ------------------------------------------------------------------ labels and levels
def test_numbers_of_labels_and_levels(spark):
    rows = [(1, "b", "x.1", 1.0), (2, None, "a", None), (3, "b", None, float("nan")), (4, "a", "é", 3.0), (5, "nan", "B", 4.0)]
    real = spark.createDataFrame(rows, "k long, `t.x` string, `c d.e` string, n double")
    classes = label_classes(real, "t.x")
    assert sorted(map(tuple, classes.table.collect())) == [("a", 0), ("b", 1), ("nan", 2)] and classes.size == 3
    other = spark.createDataFrame([(1, "zzz"), (2, None), (3, "b")], "k long, `t.x` string")
    assert sorted((r.k, r.label) for r in classes.encode(other, "t.x").collect()) == [(1, 0.0), (2, 2.0), (3, 1.0)]
    levels = category_levels(real, ["t.x", "c d.e"])
    assert levels.sizes == [3, 4] and levels.dummies == 5 and levels.first_dummies() == [1, 3]
    got = {r.k: (r.numbers, r.levels) for r in levels.encode(real, ["n"], ["k"]).collect()}
    assert got == {1: ([1.0], [1, 4]), 2: ([0.0], [0, 3]), 3: ([0.0], [1, 0]), 4: ([3.0], [0, 5]), 5: ([4.0], [2, 0])}
    flat = sorted(tuple(r) for r in sparse_entries(levels.encode(real, ["n"], ["k"]), "k", 1).collect())
    assert flat == [(1, 0, 1.0), (1, 1, 1.0), (1, 4, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 0, 3.0), (4, 5, 1.0), (5, 0, 4.0), (5, 2, 1.0)]
    wide = wide_design(real, "k", ["n"], levels)
    assert wide.columns == ["k", "n", "t.x__1", "t.x__2", "c d.e__1", "c d.e__2", "c d.e__3"]
    assert category_levels(real.limit(0), ["t.x"]).sizes == [0]


def test_many_levels_and_classes(spark):
    """100,000 levels and 500 classes: neither reaches the plan."""
    n = 120_000
    real = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("level-"), (F.col("id") % 100_000).cast("string")).alias("c"),
                                 (F.col("id") % 500).cast("double").alias("x"),
                                 F.concat(F.lit("class-"), (F.col("id") % 500).cast("string")).alias("t"))
    levels = category_levels(real, ["c"])
    assert levels.sizes == [100_000] and label_classes(real, "t").size == 500
    rows = label_classes(real, "t").encode(levels.encode(real, ["x"], ["k", "t"]), "t")
    plan = rows._jdf.queryExecution().toString()
    assert "level-7" not in plan and "class-7" not in plan
    rows = rows.select(F.col("k").alias("id"), "numbers", "levels", "label", F.array(F.lit(0).cast("long")).alias("forests"))
    votes = forest_votes(rows, rows.where("id % 100 = 0"), 1, 1, levels.dummies, trees=2, depth=12)
    total = votes.groupBy("id").agg(F.sum("share").alias("s"), F.max("label").alias("most")).collect()
    assert len(total) == 1200 and all(r.s == pytest.approx(2) and r.most < 500 for r in total)


# ------------------------------------------------------------------ failures
def test_reason_of_a_failure(spark, sf):
    train, syn, _c = fx.three_way(spark, sf)
    bad = ts.tstr(train, syn.withColumn("sum_qty", F.raise_error(F.lit("unreadable block")).cast("double")),
                  "o_orderstatus", fx.KEY, trees=2)
    assert (bad.score, bad.baseline, bad.gap) == (-1.0, -1.0, -1.0) and "TSTR failed" in bad.reason
    good = ts.tstr(train, syn.drop("sum_qty"), "o_orderstatus", fx.KEY, trees=4)       # absent feature: zeros
    assert 0 < good.score <= 1 and good.reason == ""


def test_one_failing_measurement_costs_itself_only(spark, sf, monkeypatch):
    train, syn, ctl = fx.three_way(spark, sf)
    wide = F.concat(F.lit("t"), F.pmod(F.xxhash64(fx.KEY), F.lit(150)).cast("string"))
    cfg = AuditConfig(n_attacks=100, target_col="t")
    train, syn, ctl = (df.withColumn("t", wide) for df in (train, syn, ctl))
    real_evaluate = au.evaluate

    def evaluate(real, s, *args, **kw):
        if "marked" in s.columns:
            raise RuntimeError("no utility today")
        return real_evaluate(real, s, *args, **kw)

    monkeypatch.setattr(au, "evaluate", evaluate)
    monkeypatch.setattr(ts.forest_votes, "__defaults__", (3, 42, None, fo.GROUP_ROWS, fo.ROWS_AT_ONCE))
    monkeypatch.setattr(ts, "N_TREES", 3)
    got = {r.model: r for r in au.audit(train, ctl, [au.Candidate("a", syn), au.Candidate("b", syn.withColumn("marked", F.lit(1)))],
                                        fx.KEY, cfg).collect()}
    assert got["a"].tstr_score is not None and got["a"].singling_out_risk == got["b"].singling_out_risk
    assert got["b"].correlation_similarity is None and not got["b"].utility_pass and got["b"].linkability_ci != "N/A"
    assert "no utility today" in got["b"].notes


def test_audit_table_returns_a_failed_record(spark, sf):
    from synthaudit.plans.run import audit_table

    facts = fx.cached_facts(spark, sf)
    broken = facts.withColumn("sum_qty", F.when(F.col("row_key") >= 0, F.raise_error(F.lit("unreadable"))).cast("double"))
    out = audit_table(spark, facts, broken, "row_key", AuditConfig(n_attacks=50))
    assert out["record"]["singling_out_ci"] == "N/A" and "unreadable" in out["record"]["notes"]
    assert out["report"].count() == 1


def test_small_forests_vote_where_the_rows_are(spark, monkeypatch):
    """Shipped trees give the votes of trees that rows are sent to, with tops, repeated ids and sizes counted without rows."""
    from synthaudit.operators import forest as fo

    rng = np.random.default_rng(3)
    rows = [([0, 1] if i % 3 else [1], i % 2500, [float(v) for v in rng.normal(size=2)], [int(rng.integers(0, 4)), 0], int(i % 7 == 0) + 5)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "forests array<long>, id long, numbers array<double>, levels array<int>, label int")
    dealt = []
    monkeypatch.setattr(fo, "to_arrow_schema", lambda s, make=fo.to_arrow_schema: (dealt.append(s.fieldNames()), make(s))[1])
    key = lambda v: sorted((r.forest, r.id, r.label, round(r.share, 9)) for r in v.collect())
    for group_rows in (fo.GROUP_ROWS, 300):
        monkeypatch.setattr(fo, "SMALL_FOREST", 32_000_000)
        dealt.clear()
        here = key(forest_votes(df, df, 2, 2, 3, trees=5, group_rows=group_rows))
        assert not any("ids" in names for names in dealt)          # no row to predict was sent anywhere
        # sizes are counted only where a forest has more rows than a group, and without rows
        assert any("x" not in names and "n" in names for names in dealt) == (group_rows == 300)
        monkeypatch.setattr(fo, "SMALL_FOREST", 0)
        assert key(forest_votes(df, df, 2, 2, 3, trees=5, group_rows=group_rows)) == here and here


def test_forest_rows_are_dealt_evenly(spark, monkeypatch):
    from synthaudit.operators import forest as fo

    made = []
    monkeypatch.setattr(fo, "cut_lineage", lambda df, cut=fo.cut_lineage: (made.append(cut(df)), made[-1])[1])
    rows = [([0], i, [float(i % 50)], [], i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "forests array<long>, id long, numbers array<double>, levels array<int>, label int").coalesce(1)
    forest_votes(df, df, 1, 0, 0, trees=2)
    for d in made[:2]:
        n = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        assert len(n) > 1 and max(n) < 2.5 * 1000 / len(n)


def test_rows_are_dealt_in_large_blocks():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"id": [i, i], "v": [[i], []]}) for i in range(10)]
    got = list(fo._gathered(iter(batches), 6))
    assert [b.num_rows for b in got] == [6, 6, 6, 2]
    assert pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches(batches).to_pylist()
