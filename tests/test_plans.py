"""Plan-shape guards: no query plans a Cartesian product or a nested-loop
join, and scans read only the columns they need."""

import pytest

import __spark_entry__ as E

SLOW = {"fold_accuracy", "tstr_report", "audit_end_to_end", "summary_json", "audit_reference_run",
        "cmla_risk_kmeans", "synth_copula", "synth_dptree", "src_csv_infer"}
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SLOW))
def test_no_cartesian(spark, sf, name):
    plan = _plan(E.queries()[name](spark, sf))
    for bad in BAD:
        assert bad not in plan, f"{name} plans {bad}"


def test_facts_scan_is_pruned(spark, sf):
    from synthaudit.plans import fixtures as fx

    plan = _plan(fx.facts(spark, sf))
    # lineitem: only the three columns the aggregate needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in \
        fx.facts(spark, sf)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "CartesianProduct" not in plan
