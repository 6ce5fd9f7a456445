"""Query catalog: one Spark plan per operator of the inventory, and the
equivalent DuckDB SQL used as correctness oracle.

Every query reads the given tables (or data Spark derives from them), so
its work grows with them.  Ratios are rounded to 6 decimals in both
engines; counts are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthaudit.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
R = 6  # decimals of derived doubles


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rnd(c, d: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def oracle(body: str) -> str:
    """Prefix the shared fixture CTEs to a query body (which may add CTEs
    with a leading comma)."""
    return fx.ORACLE_FIXTURES + body


def forget(spark: SparkSession) -> None:
    """Drop what queries keep for later ones, so that the next one starts from the tables."""
    for module in (fx, q_audit, q_clean, q_tstr):
        module._CACHE.clear()
    spark.catalog.clearCache()


# import the modules that register queries
from synthaudit.plans import q_utility, q_attacks, q_audit, q_clean, q_sampling, q_synth, q_tstr, q_io  # noqa: E402,F401
