"""Sinks of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from synthaudit.sources.json_io import json_safe


def write_report(report: DataFrame, path: str) -> None:
    """Ranked report (one row per model) as a single CSV file."""
    json_safe(report).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The winning synthetic table, written in parallel (not coalesced)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)
