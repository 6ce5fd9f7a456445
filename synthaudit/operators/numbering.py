"""Numbers 0, 1, 2 ... in a total order, without one task that sees all rows.

Rows are dealt by ranges of the order, sorted inside each range and written
once; a row's number is its place in its range plus the rows of the ranges
before, of which there is one count for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthaudit.session import cut_lineage

PLACE_BITS = 33             # low bits of monotonically_increasing_id: a row's place in its partition


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its rows' places in ``order`` (which should leave no ties)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.select("*", F.spark_partition_id().alias("__part"),
                                     F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1).alias("__place")))
    sizes = sorted(tuple(r) for r in dealt.groupBy("__part").count().collect())      # one row a partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long"))
    return (dealt.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__place"))
            .drop("__part", "__place", "__before"))
