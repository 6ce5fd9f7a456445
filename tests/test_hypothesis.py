"""Randomised checks of the risk arithmetic (column form == Python form)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from synthaudit.functions.risk import residual_risk


@settings(max_examples=300, deadline=None)
@given(st.integers(min_value=1, max_value=10_000).flatmap(
    lambda n: st.tuples(st.just(n), st.integers(0, n), st.integers(0, n))))
def test_residual_risk_bounds(nsc):
    n, s, c = nsc
    r, lo, hi = residual_risk(s, c, n)
    assert 0.0 <= lo <= r <= hi <= 1.0
    if s <= c:                     # the attack does no better than the baseline
        assert r == 0.0


def test_column_form_matches_random(spark):
    import random

    import pytest
    from pyspark.sql import functions as F

    from synthaudit.functions.risk import residual_risk_cols

    random.seed(11)
    rows = []
    for _ in range(200):
        n = random.randint(1, 5000)
        rows.append((random.randint(0, n), random.randint(0, n), n))
    df = spark.createDataFrame(rows, "s long, c long, n long")
    r, lo, hi = residual_risk_cols(F.col("s"), F.col("c"), F.col("n"))
    for row in df.select("s", "c", "n", r.alias("r"), lo.alias("lo"), hi.alias("hi")).collect():
        assert (row["r"], row["lo"], row["hi"]) == pytest.approx(residual_risk(row["s"], row["c"], row["n"]), abs=1e-12)
