"""Derived audit inputs built by Spark from the given tables.

``facts``: one row per order that has lines (orders ⋈ customer ⋈ per-order
lineitem aggregates), key ``row_key = o_orderkey``.  ``train`` / ``control``
are the seeded hash split of ``facts`` (the library's own T3).  ``syn`` is a
deterministic perturbation of ``train`` with known boundary breaks, nulls,
unseen labels and copies (rows with ``row_key % 50 = 0`` stay copies in
the three perturbed numeric columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthaudit.operators.sampling import train_control_split
from synthaudit.sources.tables import read_table
from synthaudit.session import session_key

KEY = "row_key"
FACT_COLUMNS = ["row_key", "o_totalprice", "c_acctbal", "n_lines", "sum_qty", "sum_price",
                "o_orderstatus", "o_orderpriority", "c_mktsegment"]


def facts(spark: SparkSession, data_dir: str) -> DataFrame:
    li = read_table(spark, data_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("long").alias("n_lines"),
        F.sum("l_quantity").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sum_price"))
    orders = read_table(spark, data_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    cust = read_table(spark, data_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    # lineitem aggregate is hash-partitioned on the order key already; the
    # join with orders reuses that partitioning.  customer is joined after.
    j = (orders.join(li, orders.o_orderkey == li.l_orderkey)
         .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    return j.select(F.col("o_orderkey").alias("row_key"), "o_totalprice", "c_acctbal", "n_lines",
                    "sum_qty", "sum_price", "o_orderstatus", "o_orderpriority", "c_mktsegment")


_CACHE: dict = {}


def cached_facts(spark: SparkSession, data_dir: str) -> DataFrame:
    """``facts`` persisted once per session and folder (memory, spill to
    disk; lost blocks are recomputed from lineage)."""
    k = (session_key(spark), data_dir)
    if k not in _CACHE:
        _CACHE[k] = facts(spark, data_dir).persist()
    return _CACHE[k]


def split(spark: SparkSession, data_dir: str, ratio: float = 0.5, seed: int = 42):
    k = (session_key(spark), data_dir, ratio, seed)
    if k not in _CACHE:
        _CACHE[k] = train_control_split(cached_facts(spark, data_dir), KEY, ratio, seed)
    return _CACHE[k]


def perturb(train: DataFrame) -> DataFrame:
    k = F.col("row_key")
    copy = (k % 50) == 0
    return train.select(
        "row_key",
        F.when(copy, F.col("o_totalprice")).otherwise(
            F.col("o_totalprice") + ((k % 21 - 10) * 1000).cast("double")).alias("o_totalprice"),
        F.when(k % 22 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "n_lines",
        F.when(copy, F.col("sum_qty")).otherwise(
            F.col("sum_qty") + ((k % 7 - 3) * 10).cast("double")).alias("sum_qty"),
        F.when(copy, F.col("sum_price")).otherwise(
            F.col("sum_price") * 0.5 + ((k % 101) * 500).cast("double")).alias("sum_price"),
        "o_orderstatus", "o_orderpriority",
        F.when(k % 26 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


def three_way(spark: SparkSession, data_dir: str, ratio: float = 0.5, seed: int = 42):
    """(train, syn, control) for the attack and utility queries."""
    train, control = split(spark, data_dir, ratio, seed)
    return train, perturb(train), control


# DuckDB text of the same fixtures (used by the oracle SQL of every query).
ORACLE_FIXTURES = """
WITH li AS (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines, sum(l_quantity) AS sum_qty,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
  FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o.o_orderkey AS row_key, o.o_totalprice, c.c_acctbal, li.n_lines, li.sum_qty, li.sum_price,
         o.o_orderstatus, o.o_orderpriority, c.c_mktsegment
  FROM orders o JOIN li ON o.o_orderkey = li.l_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(row_key AS VARCHAR)), row_key) AS rn,
         count(*) OVER () AS n_all FROM facts),
f_train AS (
  SELECT row_key, o_totalprice, c_acctbal, n_lines, sum_qty, sum_price, o_orderstatus,
         o_orderpriority, c_mktsegment FROM ranked WHERE rn <= floor(n_all * 0.5)),
f_control AS (
  SELECT row_key, o_totalprice, c_acctbal, n_lines, sum_qty, sum_price, o_orderstatus,
         o_orderpriority, c_mktsegment FROM ranked WHERE rn > floor(n_all * 0.5)),
f_syn AS (
  SELECT row_key,
    CASE WHEN row_key % 50 = 0 THEN o_totalprice
         ELSE o_totalprice + CAST((row_key % 21 - 10) * 1000 AS DOUBLE) END AS o_totalprice,
    CASE WHEN row_key % 22 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
    n_lines,
    CASE WHEN row_key % 50 = 0 THEN sum_qty
         ELSE sum_qty + CAST((row_key % 7 - 3) * 10 AS DOUBLE) END AS sum_qty,
    CASE WHEN row_key % 50 = 0 THEN sum_price
         ELSE sum_price * 0.5 + CAST((row_key % 101) * 500 AS DOUBLE) END AS sum_price,
    o_orderstatus, o_orderpriority,
    CASE WHEN row_key % 26 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment
  FROM f_train)
"""


# ---------------------------------------------------------------- raw input for cleaning
RAW_KEY = "row_key"


def raw_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """``events`` with injected nulls, an all-null column, all-null rows
    (``event_id % 97 = 0``), id-like names (``event_id``, ``width``), a
    unique text column, padded labels and date text."""
    e = read_table(spark, data_dir, "events")
    k = F.col("event_id")
    gone = (k % 97) == 0

    def nul(cond, v):
        return F.when(gone | cond, F.lit(None)).otherwise(v)

    return e.select(
        k.alias("row_key"),
        nul(F.lit(False), k).alias("event_id"),
        nul((k % 9) == 0, F.col("ts")).alias("ts"),
        nul((k % 13) == 0, F.col("ts").cast("date").cast("string")).alias("day_text"),
        nul((k % 11) == 0, F.when((k % 17) == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
            .otherwise(F.col("event_type"))).alias("event_type"),
        nul((k % 7) == 0, F.col("value")).alias("value"),
        nul(F.lit(False), F.col("props")).alias("props"),
        nul(F.lit(False), F.concat(F.lit("user-"), k.cast("string"))).alias("user_name"),
        F.lit(None).cast("double").alias("empty_col"),
        nul(F.lit(False), F.col("user_id")).alias("width"))


ORACLE_RAW = """
WITH raw AS (
  SELECT event_id AS row_key,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id END AS event_id,
    CASE WHEN event_id % 97 = 0 OR event_id % 9 = 0 THEN NULL ELSE ts END AS ts,
    CASE WHEN event_id % 97 = 0 OR event_id % 13 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day_text,
    CASE WHEN event_id % 97 = 0 OR event_id % 11 = 0 THEN NULL
         WHEN event_id % 17 = 0 THEN '  ' || event_type || ' ' ELSE event_type END AS event_type,
    CASE WHEN event_id % 97 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE props END AS props,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'user-' || CAST(event_id AS VARCHAR) END AS user_name,
    CAST(NULL AS DOUBLE) AS empty_col,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS width
  FROM events),
r1 AS (SELECT * FROM raw WHERE NOT (event_id IS NULL AND ts IS NULL AND day_text IS NULL AND event_type IS NULL
        AND value IS NULL AND props IS NULL AND user_name IS NULL AND empty_col IS NULL AND width IS NULL)),
mode_et AS (SELECT event_type AS v FROM r1 WHERE event_type IS NOT NULL GROUP BY event_type
            ORDER BY count(*) DESC, event_type LIMIT 1),
med AS (SELECT median(value) AS m FROM r1),
cleaned AS (SELECT row_key,
   coalesce(last_value(ts IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(ts IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ts,
   coalesce(last_value(day_text IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            first_value(day_text IGNORE NULLS) OVER (ORDER BY row_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS day_text,
   trim(coalesce(event_type, (SELECT v FROM mode_et))) AS event_type,
   coalesce(value, (SELECT m FROM med)) AS value,
   props FROM r1)
"""
