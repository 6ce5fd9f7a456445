"""Connected components of a table of links, by alternating large-star and
small-star rounds.  Every round is a table in the shared scratch folder; the
driver sees two numbers per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthaudit.llm.common import scratch_table


def _star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small-star: edges point from the larger to the smaller end
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["at"])
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (longs): the root
    is the smallest node of its component."""
    edges = scratch_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .where(F.col("a") != F.col("b")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        edges = scratch_table(_star(_star(edges, small=False), small=True), "links")
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
