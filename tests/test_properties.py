"""Property checks: identities, partition independence, monotonicity."""

import pytest
from pyspark.sql import functions as F

from synthaudit.operators import linkability as lk
from synthaudit.operators import logic, stats
from synthaudit.operators import singling_out as so
from synthaudit.plans import fixtures as fx


@pytest.fixture(scope="module")
def three(spark, sf):
    train, syn, ctl = fx.three_way(spark, sf)
    return train.cache(), syn.cache(), ctl.cache()


def test_identity_scores_one(three):
    train, _syn, _ctl = three
    assert stats.correlation_similarity(train, train, "row_key").first()[0] == pytest.approx(1.0)
    lg = logic.logic_score(logic.logic_check(train, train, "row_key")).first()
    assert lg["logic_consistency"] == 1.0 and lg["n_violations"] == 0


def test_repartition_changes_nothing(three):
    train, syn, ctl = three
    a_so = so.singling_out(train, syn, ctl, "row_key", 200)
    b_so = so.singling_out(train.repartition(5), syn.repartition(3), ctl.repartition(7), "row_key", 200)
    assert (a_so.n_success, a_so.n_control_success, a_so.risk_score) == \
        (b_so.n_success, b_so.n_control_success, b_so.risk_score)
    a_lk = lk.linkability(train, syn, ctl, "row_key", 150, detail=True)
    b_lk = lk.linkability(train.repartition(4), syn.repartition(6), ctl.repartition(2), "row_key", 150, detail=True)
    assert sorted(map(tuple, a_lk.collect())) == sorted(map(tuple, b_lk.collect()))
    sa = stats.correlation_similarity(train, syn, "row_key").first()[0]
    sb = stats.correlation_similarity(train.repartition(9), syn.repartition(2), "row_key").first()[0]
    assert sa == pytest.approx(sb, abs=1e-12)


def test_wider_range_never_raises_violations(three):
    train, syn, _ctl = three
    base = logic.logic_score(logic.logic_check(train, syn, "row_key")).first()["n_violations"]
    wide = train.unionByName(train.limit(1).select(
        F.lit(-1).cast("long").alias("row_key"), *[
            (F.lit(1e12) if c in ("o_totalprice", "sum_qty", "sum_price", "c_acctbal") else F.col(c)).alias(c)
            for c in train.columns if c != "row_key"]))
    widened = logic.logic_score(logic.logic_check(wide, syn, "row_key")).first()["n_violations"]
    assert widened <= base
