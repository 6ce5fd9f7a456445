"""Exact duplicates by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical after each run of white space
(blank, tab, line feed, vertical tab, form feed, carriage return) is replaced
by one blank.  Rows are told apart in three steps, each grouping only what the
step before left together:

1. by the size of the normalised text in bytes (a count for each size),
2. by a 64-bit hash of its first 256 code points, for sizes that occur twice,
3. by SHA-256 of the whole text, for (size, prefix hash) pairs that occur twice.

Steps 1 and 2 group a table of two numbers a row.  Step 3 goes back to the
texts: the surviving pairs are shipped to the scan, so only rows of surviving
groups are hashed whole and no text is ever shuffled.  If there are more
pairs than ``max_broadcast``, the scan hashes every row and the narrow rows
are joined to the pairs by a shuffle instead; the answer is the same.

Sizes that occur twice are few by arithmetic: k of them need k * k bytes of
text, so 100 TB have at most ten million.  Groups that hold at least one in
10,000 of the rows that are left are at most 10,000; their first rows are
broadcast, so a group that holds a third of the corpus is read in place and
no key of the remaining join is that frequent.

Defined cases: a null text is empty; a null id comes after all others, and is
a ``keep_id`` only where a group has no other; of rows that repeat an id in
one group a single one is kept; an empty table gives no row; other columns
are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthaudit.llm.common import scratch_table

PREFIX_CHARS = 256
MAX_BROADCAST = 1_000_000      # keys of 12 bytes that the scan may be sent
HOT_GROUPS = 10_000


def normalise(text: Column) -> Column:
    """``text`` with one blank for each run of white space (a lone blank needs no change)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _few(keys: DataFrame, limit: int) -> bool:
    return keys.limit(limit + 1).count() <= limit


def refine(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The (``size``, ``prefix``) pairs that two or more rows of ``docs`` share."""
    text = normalise(F.col("text"))
    keys = scratch_table(docs.select(F.octet_length(text).alias("size"),
                                     F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix")), "exact-keys")
    sizes = scratch_table(keys.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size"), "exact-sizes")
    if _few(sizes, max_broadcast):
        sizes = F.broadcast(sizes)
    again = keys.join(sizes, "size", "left_semi").groupBy("size", "prefix").agg(F.count("*").alias("n"))
    return scratch_table(again.where("n > 1").select("size", "prefix"), "exact-prefixes")


def exact_duplicates(docs: DataFrame, carry: Column | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id`` (the smallest id of
    its texts), ``group_size``, ``kept``, ``full_hash`` (SHA-256, null where
    size and prefix alone show that no other text is equal) and ``carried``,
    the value of ``carry``."""
    pairs = refine(docs, max_broadcast)
    text = normalise(F.col("text"))
    whole = F.unhex(F.sha2(text, 256))
    carried = F.lit(None).cast("boolean") if carry is None else carry
    rows = docs.select("doc_id", "text", carried.alias("carried"), F.octet_length(text).alias("size"),
                       F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"))
    pairs = pairs.withColumn("shared", F.lit(True))
    if _few(pairs, max_broadcast):
        rows = (rows.join(F.broadcast(pairs), ["size", "prefix"], "left")
                .select("doc_id", "carried", F.when(F.col("shared"), whole).alias("full_hash")))
    else:
        rows = (rows.select("doc_id", "carried", "size", "prefix", whole.alias("whole"))
                .join(pairs, ["size", "prefix"], "left")
                .select("doc_id", "carried", F.when(F.col("shared"), F.col("whole")).alias("full_hash")))
    # numbered in a written table, so that rows which repeat an id stay apart
    rows = scratch_table(rows.withColumn("row", F.monotonically_increasing_id()), "exact-rows")

    groups = (rows.where("full_hash IS NOT NULL").groupBy("full_hash")
              .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
                   F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("first")))
    groups = scratch_table(groups, "exact-groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.col("group_size") >= max(2, -(-total // HOT_GROUPS))

    single = rows.where("full_hash IS NULL").withColumns(
        {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "first": F.col("row")})
    shared = rows.where("full_hash IS NOT NULL")
    frequent = F.broadcast(groups.where(hot))                       # at most HOT_GROUPS rows
    inside = shared.join(frequent, "full_hash")
    rest = shared.join(F.broadcast(groups.where(hot).select("full_hash")), "full_hash", "left_anti").join(
        groups.where(~hot), "full_hash")
    return (single.unionByName(inside).unionByName(rest)
            .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "full_hash",
                    "carried"))


def drop_exact_duplicates(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose text an earlier id has."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return exact_duplicates(docs, row, max_broadcast).where("kept").select("carried.*")
