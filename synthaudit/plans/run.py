"""The whole audit from a source to the exported report (the CLI flow).

``run_framework(spark, source)``: read (CSV path or DataFrame) → clean
(I9) → optional row cap (T1) → seeded split (T3) → fit every configured
generator on train and sample as many rows (N*) while the real-side
statistics are computed → audit every candidate (O1) → rank and recommend
(T5–T7) → optional export of the ranked report (S5), the winner's
synthetic table (S6) and the nested summary (S7).
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.config import AuditConfig, LoaderConfig
from synthaudit.operators.clean import load_and_clean, nan_to_null
from synthaudit.operators.profile import apply_types
from synthaudit.operators.sampling import sample_n, train_control_split
from synthaudit.plans import audit as au
from synthaudit.session import cut_lineage
from synthaudit.sources.csv import read_csv
from synthaudit.sources.json_io import write_summary
from synthaudit.sources.sinks import write_report, write_table


def with_long_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``key`` as a unique long.  A key of another type, or one that
    the table lacks, is replaced by a number in key (or row) order, materialised
    once; a key with gaps or repeats is refused."""
    if key not in df.columns:
        return cut_lineage(df.withColumn(key, F.monotonically_increasing_id()))
    n, named, distinct = df.agg(F.count(F.lit(1)), F.count(F.col(f"`{key}`")), F.count_distinct(F.col(f"`{key}`"))).first()
    if not n == named == distinct:
        raise ValueError(f"key '{key}' must be unique and without nulls: {n} rows, {named} keys, {distinct} distinct")
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return df.withColumn(key, F.col(f"`{key}`").cast("long"))
    return cut_lineage(df.orderBy(F.col(f"`{key}`")).withColumn(key, F.monotonically_increasing_id()))


def run_framework(spark: SparkSession, source, key: str | None = None, cfg: AuditConfig | None = None,
                  loader_cfg: LoaderConfig | None = None, output_dir: str | None = None) -> dict:
    cfg = cfg or AuditConfig()
    t0 = time.perf_counter()
    if isinstance(source, DataFrame):
        df = source
    else:
        df = read_csv(spark, source, key)
    key = key or "row_key"
    df = with_long_key(df, key)
    cleaned = load_and_clean(df, key, loader_cfg)
    # the cleaned table ends several shuffles: materialise it in the shared
    # checkpoint folder so a lost executor re-reads it instead of re-cleaning
    real = cut_lineage(cleaned.df)
    capped = sample_n(real, key, cfg.max_rows, cfg.random_seed)
    train, control = train_control_split(capped, key, cfg.train_ratio, cfg.random_seed)
    side = au.RealSide(train, control, key, cfg).start()

    tables = {}

    # generators are fitted, sampled and audited while the real side is computed
    makers = {name: (lambda name=name, kw=kw: au.make_candidate(name, kw, side, cfg.random_seed, tables)) for name, kw in cfg.models.items()}
    records = au.audit_generators(side, makers).cache()
    report = au.rank_models(records)
    best = au.recommend(records)
    runtime = time.perf_counter() - t0
    summary = au.summary(records, cfg, runtime)
    if output_dir:
        write_report(au.full_report(records), os.path.join(output_dir, "final_audit_report"))
        winner = tables.get(best)
        if winner is not None:
            write_table(winner, os.path.join(output_dir, f"{best}_best_synthetic"), fmt="csv")
        write_summary(summary, os.path.join(output_dir, "audit_summary"))
    # release cached inputs; the records are a small local table
    for t in tables.values():
        t.unpersist()
    side.release()
    real.unpersist()
    return {"records": records, "report": report, "recommended": best, "summary": summary,
            "cleaning": cleaned, "runtime_seconds": runtime}


def audit_table(spark: SparkSession, real, syn, key: str, cfg: AuditConfig | None = None,
                name: str = "given", cluster_labels: str | None = None,
                loader_cfg: LoaderConfig | None = None) -> dict:
    """O2: audit a table that was synthesised elsewhere against real data
    (CSV paths or DataFrames).  Real rows are split as in the full run; the
    synthetic table is scored against the training part."""
    cfg = cfg or AuditConfig()
    real_df = real if isinstance(real, DataFrame) else read_csv(spark, real, key)
    syn_df = syn if isinstance(syn, DataFrame) else read_csv(spark, syn, key)
    # the synthetic table keeps its rows; it is read with the columns that cleaning left
    real_df = cut_lineage(load_and_clean(with_long_key(real_df, key), key, loader_cfg).df)
    syn_df = nan_to_null(with_long_key(syn_df, key))
    if loader_cfg:
        syn_df = apply_types(syn_df, loader_cfg.metadata_overrides)
    syn_df = syn_df.select(*[F.col(f"`{c}`") for c in real_df.columns if c in syn_df.columns])
    capped = sample_n(real_df, key, cfg.max_rows, cfg.random_seed)
    train, control = train_control_split(capped, key, cfg.train_ratio, cfg.random_seed)
    side = au.RealSide(train, control, key, cfg, cluster_labels).start()
    try:
        record = au.isolated_pair(side, syn_df, name, {}, 0)
    finally:
        side.release()
    records = au.records_frame(spark, [record])         # a local table of one row
    return {"record": record, "records": records, "report": au.rank_models(records)}
