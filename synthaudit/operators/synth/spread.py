"""Text columns with more values than a model has codes.

Values share codes by hash, the model works on the codes, and a sampled code
draws one of its values by their shares.  The values stay a Spark table: no
value is lost and nothing that grows with them reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthaudit.session import cut_lineage

SHARED = "\u0001"           # first character of a code that several values share
ROWS_PER_TASK = 1_000_000   # sampled rows of a task, once there are more than the cluster has slots


def sample_ids(spark, n: int) -> DataFrame:
    """``id`` 0..n-1 over tasks whose number grows with ``n``."""
    return spark.range(0, n, 1, max(1, spark.sparkContext.defaultParallelism, n // ROWS_PER_TASK))


def shared_code(value: Column, codes: int) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(SHARED), F.pmod(F.xxhash64(value), F.lit(codes))))


class Spread:
    """The values of one column behind their codes; ``counts`` has rows
    ``v, n`` (positive counts), ``size`` of them."""

    def __init__(self, counts: DataFrame, codes: int, size: int):
        by_value = Window.partitionBy("code").orderBy("v")
        own = counts.select(shared_code(F.col("v"), codes).alias("code"), "v", "n")
        upto = F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("n").over(Window.partitionBy("code"))
        # shares as a running sum: a value begins where the one before it ends, the last ends at 1
        hi = F.when(F.lead("v").over(by_value).isNull(), 1.0).otherwise(F.least(upto / total, F.lit(1.0)))
        ends = own.select("code", "v", hi.alias("hi"))
        ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(by_value), F.lit(0.0)))
        # [0, 1) in as many cells as a code has values on average: a draw looks only at the
        # values of its cell, about two of them, and a frequent value has many cells
        self.cells = -(-size // codes)
        cell = F.explode(F.sequence(F.floor(F.col("lo") * self.cells), F.least(
            F.floor(F.col("hi") * self.cells), F.lit(self.cells - 1).cast("long"))))
        self.values = cut_lineage(ends.select("code", "v", "lo", "hi", cell.alias("cell")))

    def codes(self) -> list[str]:
        return [r["code"] for r in self.values.select("code").distinct().collect()]

    def draw(self, rows: DataFrame, column: str, uniform: Column) -> DataFrame:
        """``rows`` with the codes of ``column`` replaced by values; a NULL stays."""
        own = self.values.withColumnRenamed("v", "__v")
        rows = rows.withColumn("__u", uniform)
        rows = rows.join(own, (rows[f"`{column}`"] == own["code"]) & (F.floor(rows["__u"] * self.cells) == own["cell"])
                         & (rows["__u"] >= own["lo"]) & (rows["__u"] < own["hi"]), "left")
        return rows.withColumn(column, F.col("__v")).drop("__u", "__v", "code", "cell", "lo", "hi")
