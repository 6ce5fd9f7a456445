"""Wilson interval + residual risk, golden intervals of the saved run."""

import pytest

from synthaudit.functions.risk import residual_risk, residual_risk_cols

# (s, c) pairs with n = 500 that reproduce the published values (value, upper).
GOLDEN = [((6, 4), 0.004017, 0.017525), ((1, 0), 0.001992, 0.008659), ((5, 4), 0.002008, 0.014956),
          ((2, 1), 0.001996, 0.010660), ((5, 3), 0.004009, 0.016320)]


@pytest.mark.parametrize("sc,value,hi", GOLDEN)
def test_golden_intervals(sc, value, hi):
    r, lo, up = residual_risk(sc[0], sc[1], 500)
    assert round(r, 6) == pytest.approx(value, abs=1e-6)
    assert round(up, 6) == pytest.approx(hi, abs=1e-6)
    assert lo == 0.0
    assert f"[{lo:.3f}, {up:.3f}]"  # text form exists


def test_bounds_and_order():
    for s in range(0, 50, 7):
        for c in range(0, 50, 9):
            r, lo, hi = residual_risk(s, c, 100)
            assert 0.0 <= lo <= r <= hi <= 1.0


def test_no_attacks_is_max_risk():
    assert residual_risk(0, 0, 0) == (1.0, 1.0, 1.0)


def test_column_form_matches(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(6, 4, 500), (1, 0, 500), (30, 2, 100)], "s long, c long, n long")
    r, lo, hi = residual_risk_cols(F.col("s"), F.col("c"), F.col("n"))
    for row in df.select("s", "c", "n", r.alias("r"), lo.alias("lo"), hi.alias("hi")).collect():
        exp = residual_risk(row["s"], row["c"], row["n"])
        assert (row["r"], row["lo"], row["hi"]) == pytest.approx(exp, abs=1e-12)
