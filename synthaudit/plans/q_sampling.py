"""Queries: seeded sampling and the exact split."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthaudit.operators import sampling as sp
from synthaudit.plans import fixtures as fx
from synthaudit.plans.catalog import oracle, query

ORDER = "md5('42|' || CAST(row_key AS VARCHAR)), row_key"


@query("sample_n", oracle(f"SELECT row_key FROM facts ORDER BY {ORDER} LIMIT 2000"))
def sample_n(spark, d):
    """T1 with the original tool's cap of 2,000 rows (top-k path)."""
    return sp.sample_n(fx.cached_facts(spark, d), fx.KEY, 2000).select(fx.KEY)


@query("sample_n_large", oracle(f"SELECT row_key FROM facts ORDER BY {ORDER} LIMIT 12000"))
def sample_n_large(spark, d):
    """T1 above the top-k limit: histogram threshold path."""
    return sp.sample_n(fx.cached_facts(spark, d), fx.KEY, 12000).select(fx.KEY)


@query("train_control_split", oracle("""SELECT row_key, CASE WHEN rn <= floor(n_all * 0.5) THEN 'train'
  ELSE 'control' END AS part FROM ranked"""))
def train_control_split(spark, d):
    train, control = fx.split(spark, d)
    return (train.select(fx.KEY, F.lit("train").alias("part"))
            .unionByName(control.select(fx.KEY, F.lit("control").alias("part"))))


@query("attack_cap", oracle("""SELECT CAST(least(500, (SELECT count(*) FROM f_train), (SELECT count(*) FROM f_control),
  (SELECT count(*) FROM f_syn)) AS BIGINT) AS n_attacks"""))
def attack_cap(spark, d):
    train, syn, ctl = fx.three_way(spark, d)
    n = sp.attack_cap(500, train.count(), ctl.count(), syn.count())
    return spark.createDataFrame([(n,)], "n_attacks bigint")
