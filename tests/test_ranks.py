"""Exact ranks of many columns, and the generators' knots and column names."""

import numpy as np
from pyspark.sql import functions as F

from synthaudit.operators import ranks as rk
from synthaudit.operators.ranks import key_values, knot_ranks, order_keys, values_at_ranks
from synthaudit.operators.synth import build


def test_keys_order_like_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 7e88, np.inf, np.nan])
    keys = order_keys(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == len(x) - 1
    assert np.array_equal(key_values(keys), x + 0.0, equal_nan=True)


def test_against_sorting(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cols = {"a.b": rng.normal(size=4000), "ties": rng.integers(-3, 3, 4000).astype(float), "one": np.full(4000, 2.5),
            "wide": rng.choice([1e-200, -1e200, 3.0, np.inf, -np.inf], 4000) * 1.0, "close": 1 + rng.integers(0, 4000, 4000) * 2.0 ** -52}
    rows = [tuple(float(v[i]) if (i + j) % 9 else None for j, v in enumerate(cols.values())) for i in range(4000)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    want, ask = [], []
    for j in range(len(cols)):
        v = np.sort([r[j] for r in rows if r[j] is not None])
        ask.append(knot_ranks(len(v), 101) + [0, len(v) - 1])
        want.append(v[ask[-1]])
    for few in (rk.FEW_ROWS, 0):                    # by the whole key at once, and 8 bits a pass to the end
        monkeypatch.setattr(rk, "FEW_ROWS", few)
        got = values_at_ranks(df, list(cols), ask)
        assert all(np.array_equal(g, w) for g, w in zip(got, want))
    assert values_at_ranks(df, [], []) == []


def test_generators_take_any_column_name(spark):
    df = spark.range(3000).select(F.col("id").alias("row.key"), (F.col("id") % 91).cast("double").alias("a.b"),
                                  F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), F.col("id") % 4)).alias("c`d"),
                                  (F.col("id") % 7).alias("capital-gain"))
    for name, options in (("copula", {}), ("privbayes", {"noise_seed": 1, "bounds": {"a.b": (0.0, 91.0)}})):
        model = build(name, **options).fit(df, "row.key")
        syn = model.sample(500, seed=2)
        assert syn.columns == df.columns and dict(syn.dtypes) == dict(df.dtypes) and syn.count() == 500
        assert syn.where(F.col("`a.b`") > 0).count() > 400
    assert build("privbayes", noise_seed=1, bounds={"a.b": (0.0, 91.0), "capital-gain": (0, 7)}).fit(
        df, "row.key").config["epsilon_spent"]["preprocessing"] == 0.0
