"""Queries: sources and sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.session import ensure_checkpoint_dir
from synthaudit.sources.csv import read_csv
from synthaudit.sources.json_io import json_safe, read_json_text
from synthaudit.sources.sinks import write_table
from synthaudit.sources.tables import read_table
from synthaudit.plans.catalog import query


def scratch_path(spark, name: str) -> str:
    """A fresh folder inside the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


@query("src_csv_infer", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
  c_mktsegment FROM customer""")
def src_csv_infer(spark, d):
    """The customer table round-tripped through CSV and re-inferred."""
    path = scratch_path(spark, "csv-roundtrip")
    write_table(read_table(spark, d, "customer"), path, fmt="csv")
    back = read_csv(spark, path)
    return back.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("src_csv_quoted", """SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_key, c_custkey,
  c_name || chr(10) || '"' || c_mktsegment || '", ' || chr(10) || CAST(c_custkey AS VARCHAR) AS note, c_acctbal FROM customer""")
def src_csv_quoted(spark, d):
    """Values with line breaks, quotes and separators, read by parts of
    files and numbered in file order."""
    path = scratch_path(spark, "csv-quoted")
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", \n'), F.col("c_custkey").cast("string"))
    rows = read_table(spark, d, "customer").select("c_custkey", note.alias("note"), "c_acctbal")
    write_table(rows.repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey"), path, fmt="csv")
    return read_csv(spark, path).select("row_key", "c_custkey", "note", "c_acctbal")


@query("json_safe", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <= 3 THEN NULL ELSE l_discount END AS v,
  CASE WHEN l_linenumber <= 3 THEN NULL ELSE l_discount END AS arr0, l_tax AS arr1,
  CASE WHEN l_linenumber <= 3 THEN NULL ELSE l_discount END AS st_x, l_quantity AS st_q FROM lineitem""")
def json_safe_q(spark, d):
    li = read_table(spark, d, "lineitem")
    ln = F.col("l_linenumber")
    v = (F.when(ln == 1, F.lit(float("nan"))).when(ln == 2, F.lit(float("inf")))
         .when(ln == 3, F.lit(float("-inf"))).otherwise(F.col("l_discount")))
    df = li.select("l_orderkey", "l_linenumber", v.alias("v"), F.array(v, F.col("l_tax")).alias("arr"),
                   F.struct(v.alias("x"), F.col("l_quantity").alias("q")).alias("st"))
    s = json_safe(df)
    return s.select("l_orderkey", "l_linenumber", "v", F.col("arr")[0].alias("arr0"), F.col("arr")[1].alias("arr1"),
                    F.col("st.x").alias("st_x"), F.col("st.q").alias("st_q"))


@query("json_tolerant_read", """SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0
  THEN NULL ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k FROM events""")
def json_tolerant_read(spark, d):
    ev = read_table(spark, d, "events")
    k = F.col("event_id")
    text = (F.when(k % 5 == 0, F.lit('{"k": NaN}')).when(k % 7 == 0, F.lit('{"k": Infinity}'))
            .when(k % 11 == 0, F.lit('{"k": -Infinity}')).otherwise(F.col("props")))
    parsed = read_json_text(ev.select("event_id", text.alias("txt")), "txt",
                            T.StructType([T.StructField("k", T.DoubleType())]))
    return parsed.select("event_id", F.col("parsed.k").alias("k"))


@query("run_framework_csv")
def run_framework_csv(spark, d):
    """The CSV flow end to end: ``facts`` with injected gaps is written as
    CSV, then read, cleaned, split, synthesised, audited and exported."""
    from synthaudit.config import AuditConfig
    from synthaudit.plans import fixtures as fx
    from synthaudit.plans.run import run_framework
    from synthaudit.plans.q_synth import BOUNDS

    k = F.col("row_key")
    src = fx.cached_facts(spark, d).select(
        "row_key", "o_totalprice",
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "n_lines", "sum_qty", "sum_price", "o_orderstatus",
        F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        "c_mktsegment")
    path = scratch_path(spark, "run-input")
    write_table(src, path, fmt="csv")
    cfg = AuditConfig(models={"copula": {}, "privbayes": {"bounds": BOUNDS}, "tvae": {}})
    out = run_framework(spark, path, key="row_key", cfg=cfg, output_dir=scratch_path(spark, "run-output"))
    return out["report"]
