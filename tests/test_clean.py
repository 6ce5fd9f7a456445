"""Profiling and cleaning rules on hand-made fixtures (FIXTURES §5)."""

import math

import pytest
from pyspark.sql import functions as F

from synthaudit.config import LoaderConfig
from synthaudit.operators import clean as cl
from synthaudit.operators import profile as pf
from synthaudit.operators import stats


def test_nulls_all(spark):
    df = spark.createDataFrame([(1, 1, "x", None), (2, None, None, None), (3, 3, None, None)],
                               "k long, a int, b string, c double")
    kept = pf.drop_null_rows(df, "k")
    assert [r.k for r in kept.orderBy("k").collect()] == [1, 3]
    plan = pf.profile(kept, "k")
    assert plan.all_null == ["c"]


def test_id_names_substring_and_token():
    cfg = LoaderConfig()
    names = ["user_id", "uuid", "row_num", "index_a", "width", "residence", "age"]
    assert [n for n in names if pf.id_like(n, cfg)] == ["user_id", "uuid", "row_num", "index_a", "width", "residence"]
    tok = LoaderConfig(id_match="token")
    assert [n for n in names if pf.id_like(n, tok)] == ["user_id", "uuid", "row_num", "index_a"]


def test_cardinality_strict(spark):
    rows = []
    for i in range(10):
        rows.append((i, f"a{i % 4}", f"b{i % 5}", f"c{i % 6}"))
    df = spark.createDataFrame(rows, "k long, r04 string, r05 string, r06 string")
    plan = pf.profile(df, "k")
    assert plan.high_card == ["r06"]          # 0.5 is kept: strictly greater drops
    assert plan.ratios["r05"] == pytest.approx(0.5)


def test_datetime_probe(spark):
    rows = [(i, f"2024-01-0{i % 9 + 1}", f"2024-02-0{i % 9 + 1}" if i != 3 else "oops", "text") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "k long, d string, bad string, t string")
    res = pf.datetime_probe(df, "k", ["d", "bad", "t"])
    assert res == {"d": True, "bad": False, "t": False}


def test_ffill_bfill_gaps(spark):
    import datetime as dt

    t = [None, None, dt.datetime(2024, 1, 3), None, dt.datetime(2024, 1, 5), None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(t)], "k long, ts timestamp")
    out = [r.ts for r in cl.ffill_bfill(df, "k", ["ts"]).orderBy("k").collect()]
    d3, d5 = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5)
    assert out == [d3, d3, d3, d3, d5, d5, d5]


def test_ffill_many_buckets_matches_one(spark):
    import random

    random.seed(1)
    rows = [(i, None if random.random() < 0.4 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    a = {r.k: r.v for r in cl.ffill_bfill(df, "k", ["v"], n_rows=3000).collect()}
    # force many buckets: 50 rows per bucket
    db, nb = cl.key_buckets(df, "k", 3000, rows_per_bucket=50)
    assert nb > 20
    old = cl.FILL_BUCKET_ROWS
    cl.FILL_BUCKET_ROWS = 50
    try:
        b = {r.k: r.v for r in cl.ffill_bfill(df, "k", ["v"], n_rows=3000).collect()}
    finally:
        cl.FILL_BUCKET_ROWS = old
    assert a == b
    last = None
    first_known = next(v for _, v in sorted(rows) if v is not None)
    for k, v in sorted(rows):
        last = v if v is not None else last
        assert a[k] == (last if last is not None else first_known)


def test_mode_ties_and_trim(spark):
    df = spark.createDataFrame([(1, " b"), (2, "a"), (3, " b"), (4, "a"), (5, None), (6, "c")], "k long, s string")
    assert cl.mode_value(df, "s") == " b"     # tie: smallest value (" b" < "a")
    plan = pf.profile(df, "k")
    out, log = cl.impute(df, plan, "k")
    vals = [r.s for r in out.orderBy("k").collect()]
    assert vals == ["b", "a", "b", "a", "b", "c"]
    assert log[0][:2] == ("s", "mode")


def test_median_even_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 4.0), (3, float("nan")), (4, 2.0), (5, 10.0), (6, None)],
                               "k long, v double")
    assert cl.exact_median(df, "v") == pytest.approx(3.0)


def test_median_bracketing_exact(spark):
    import random

    random.seed(3)
    vals = [random.gauss(0, 1) for _ in range(5001)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v double")
    old = cl.EXACT_ROWS
    cl.EXACT_ROWS = 100
    try:
        m = cl.exact_median(df, "v")
    finally:
        cl.EXACT_ROWS = old
    assert m == sorted(vals)[2500]


def test_short_guard(spark):
    df = spark.createDataFrame([(i, float(i), "x") for i in range(49)], "k long, v double, s string")
    with pytest.raises(cl.LoaderError):
        cl.load_and_clean(df, "k")


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(i, 1.0, float(i), float(i * i)) for i in range(10)], "k long, c double, x double, y double")
    m = {(r.col_a, r.col_b): r.corr for r in stats.correlation_matrix(df, key="k").collect()}
    assert m[("c", "x")] is None and m[("c", "y")] is None
    assert m[("x", "y")] == pytest.approx(0.9626, abs=1e-3)
    sim = stats.correlation_similarity(df, df, key="k").first()[0]
    assert sim is None                         # undefined r -> undefined score (D9)


def test_gram_path_equals_aggregate_path(spark):
    import random

    random.seed(5)
    cols = [f"c{i}" for i in range(6)]
    rows = [(i, *[None if random.random() < 0.1 else random.random() * (j + 1) for j in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols))
    a = {(r.col_a, r.col_b): r.corr for r in stats.correlation_matrix(df, key="k").collect()}
    old = stats.GRAM_PAIR_LIMIT
    stats.GRAM_PAIR_LIMIT = 0
    try:
        b = {(r.col_a, r.col_b): r.corr for r in stats.correlation_matrix(df, key="k").collect()}
    finally:
        stats.GRAM_PAIR_LIMIT = old
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9)
    # pairwise-complete against pandas
    pdf = df.toPandas().drop(columns="k")
    pc = pdf.corr()
    for (x, y), v in a.items():
        assert v == pytest.approx(pc.loc[x, y], abs=1e-9)


def test_semantic_types_and_overrides(spark):
    rows = [(i, i, i % 3, float(i) / 3, f"u{i}", f"g{i % 2}", True, "2024-01-01") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, ident long, small int, x double, name string, grp string, "
                                     "flag boolean, day string")
    st = {r.column: r.sdtype for r in pf.semantic_type(df, "k", overrides={"x": "categorical", "nope": "id"}).collect()}
    assert st == {"ident": "id", "small": "categorical", "x": "categorical", "name": "id", "grp": "categorical",
                  "flag": "boolean", "day": "datetime"}


def test_median_heavy_ties(spark):
    vals = [5.0] * 3000 + [1.0] * 1000 + [9.0] * 999
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v double")
    old = cl.EXACT_ROWS
    cl.EXACT_ROWS = 100
    try:
        assert cl.exact_median(df, "v") == 5.0
    finally:
        cl.EXACT_ROWS = old


def test_mode_values_batched(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "b", "y"), (4, "a", "y"), (5, None, None)],
                               "k long, s string, t string")
    assert cl.mode_values(df, ["s", "t"]) == {"s": "a", "t": "y"}
    empty = spark.createDataFrame([(1, None)], "k long, u string")
    assert cl.mode_values(empty, ["u"]) == {"u": None}


def test_imputation_log_text(spark):
    rows = [(i, None if i % 5 == 0 else float(i) * 1.5, None if i % 7 == 0 else ("a" if i % 2 else "b"))
            for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v double, s string")
    res = cl.load_and_clean(df, "k")
    text = res.log_text()
    # rows 0 and 35 are all-NULL and dropped first
    assert text["v"].startswith("median=") and text["v"].endswith("(10 nulls)")
    assert text["s"] == "mode='a' (7 nulls)"
    assert res.log_frame(spark).count() == 2


def test_medians_of_several_columns(spark, monkeypatch):
    """All columns in the same passes: ties, gaps, NaN, an empty column, and brackets that must narrow."""
    import random

    random.seed(4)
    rows = [(i, random.choice([1.0, 2.0]), None if i % 5 == 0 else random.gauss(0, 9), None, float(i % 3),
             float("nan") if i % 2 else float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, two double, `odd-name` double, none double, tri double, half double")
    cols = ["two", "odd-name", "none", "tri", "half"]

    def middle(j):
        v = sorted(r[j] for r in rows if r[j] is not None and r[j] == r[j])
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None

    want = {c: middle(j + 1) for j, c in enumerate(cols)}
    assert cl.exact_medians(df, cols) == want
    monkeypatch.setattr(cl, "EXACT_ROWS", 50)
    assert cl.exact_medians(df, cols) == want


def test_boolean_mode_false(spark):
    df = spark.createDataFrame([(i, None if i == 0 else i > 90, float(i)) for i in range(100)], "k long, b boolean, v double")
    out = cl.load_and_clean(df, "k").df
    assert out.where("k = 0").first()["b"] is False and dict(out.dtypes)["b"] == "boolean"


def test_probe_looks_beyond_a_gap(spark):
    df = spark.createDataFrame([(i, None if i < 40 else "2024-01-05", "x" if i == 99 else "2024-01-05") for i in range(100)],
                               "k long, late string, bad_end string")
    assert pf.datetime_probe(df, "k", ["late", "bad_end"]) == {"late": True, "bad_end": True}


def test_overrides_reach_the_columns(spark):
    df = spark.createDataFrame([(1, 7, "3.5", "2024-01-05"), (2, 8, "x", "2024-02-01")], "k long, a int, b string, t string")
    got = pf.apply_types(df, {"a": "categorical", "b": "numerical", "t": "datetime", "gone": "numerical"})
    assert dict(got.dtypes) == {"k": "bigint", "a": "string", "b": "double", "t": "timestamp"}
    assert [r["b"] for r in got.orderBy("k").collect()] == [3.5, None]


def test_wide_correlations_move_blocks(spark, monkeypatch):
    """Blocks of columns that do not divide evenly give the same matrix as the aggregate."""
    import random

    rng = random.Random(2)
    cols = [f"c{i}" for i in range(11)]
    rows = [(i, *[None if rng.random() < 0.2 else rng.gauss(j, 1 + j) for j in range(11)]) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols)).repartition(9)
    narrow = {(r.col_a, r.col_b): r.corr for r in stats.correlation_matrix(df, key="k").collect()}
    monkeypatch.setattr(stats, "GRAM_PAIR_LIMIT", 0)
    monkeypatch.setattr(stats, "TILE", 4)
    monkeypatch.setattr(stats, "FAN_IN", 2)
    wide = {(r.col_a, r.col_b): r.corr for r in stats.correlation_matrix(df, key="k").collect()}
    assert wide.keys() == narrow.keys() and all(wide[k] == pytest.approx(narrow[k], abs=1e-9) for k in narrow)
