"""The documented ways in, on ordinary input: odd names, text keys, defaults."""

import pytest
from pyspark.sql import functions as F

from synthaudit.config import AuditConfig
from synthaudit.operators.clean import load_and_clean
from synthaudit.operators.synth import build
from synthaudit.plans.run import audit_table, run_framework, with_long_key


def adults(spark, n=400, shift=0):
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("k"), k).alias("ref"), (k * 37 % 1000 + shift).cast("long").alias("capital-gain"),
        ((k * 13) % 60 + 17).cast("double").alias("hours per week"),
        F.element_at(F.array(F.lit("a-1"), F.lit("a_1"), F.lit("b")), (k % 3 + 1).cast("int")).alias("work-class"))


def test_defaults_run_on_a_csv(spark, tmp_path):
    adults(spark).drop("ref").coalesce(2).write.option("header", True).csv(str(tmp_path / "in"))
    out = run_framework(spark, str(tmp_path / "in"), cfg=AuditConfig(n_attacks=30), output_dir=str(tmp_path / "out"))
    rows = {r.model: r for r in out["records"].collect()}
    assert set(rows) == {"copula", "dptree"}
    assert all(r.singling_out_ci != "N/A" for r in rows.values()), {m: r.notes for m, r in rows.items()}
    report = spark.read.option("header", True).csv(str(tmp_path / "out" / "final_audit_report"))
    assert {"rank", "model", "privacy_score", "tstr_gap", "notes", "is_recommended"} <= set(report.columns)
    results = out["summary"].first()["results"]
    scores = [r["composite_score"] for r in results]
    assert scores == sorted(scores, reverse=True)


def test_audit_table_from_csv_and_text_key(spark, tmp_path):
    for name, shift in (("real", 0), ("syn", 3)):
        adults(spark, shift=shift).write.option("header", True).csv(str(tmp_path / name))
    out = audit_table(spark, str(tmp_path / "real"), str(tmp_path / "syn"), "ref", cfg=AuditConfig(n_attacks=30))
    assert out["record"]["singling_out_ci"] != "N/A" and "FAILED" not in (out["record"]["cmla_notes"] or "")


def test_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "k string, v int").repartition(3)
    got = {r.v: r.k for r in with_long_key(df, "k").collect()}
    assert got[2] < got[1] < got[3]
    assert with_long_key(df, "new").select("new").distinct().count() == 3
    for bad in ([("a", 1), ("a", 2)], [("a", 1), (None, 2)]):
        with pytest.raises(ValueError):
            with_long_key(spark.createDataFrame(bad, "k string, v int"), "k")


def test_one_broken_model_costs_its_own_record(spark, monkeypatch):
    from synthaudit.operators.synth import base

    class Broken(base.Synthesizer):
        name = "broken"

        def _fit(self, df, key):
            raise TypeError("no such thing")
    monkeypatch.setitem(base.REGISTRY, "broken", Broken)
    out = run_framework(spark, adults(spark).drop("ref"), cfg=AuditConfig(n_attacks=20, models={"broken": {}, "copula": {}}))
    rows = {r.model: r for r in out["records"].collect()}
    assert "no such thing" in rows["broken"].notes and rows["copula"].singling_out_ci != "N/A"


def test_nan_and_boolean_gaps(spark):
    rows = [(i, float("nan") if i % 5 == 0 else float(i), None if i % 4 == 0 else i % 3 > 0, f"t{i % 3}") for i in range(100)]
    res = load_and_clean(spark.createDataFrame(rows, "row_key long, x double, flag boolean, t string"), "row_key")
    got = res.df.agg(F.count_if(F.isnan("x")), F.count_if(F.col("flag").isNull())).first()
    assert tuple(got) == (0, 0) and dict(res.df.dtypes)["flag"] == "boolean"
    log = {c: (s, n) for c, s, _, n in res.imputation_log}
    assert log["x"] == ("median", 20) and log["flag"] == ("mode", 25)


def test_far_value_does_not_overflow(spark):
    df = spark.range(200).select(F.col("id").alias("row_key"), F.when(F.col("id") == 7, 1e12).otherwise(
        F.col("id").cast("double")).alias("x"), (F.col("id") % 5).cast("string").alias("c"))
    got = build("dptree", epsilon=1.0, bounds={"x": (0.0, 50.0)}).fit(df, "row_key").sample(100)
    assert got.agg(F.max("x")).first()[0] <= 50
