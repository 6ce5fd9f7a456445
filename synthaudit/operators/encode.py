"""Labels and category levels as numbers.

The distinct values of real are numbered in sorted order and stay a Spark
table: neither the plan nor the driver holds them, only how many there are.

* labels (M3): code = number of the target value as text (NULL is 'nan');
  a label that real does not have becomes the first one (J5);
* levels (M5, J6): every text column's first level, NULL and levels that real
  does not have are all zero; each other level is a dummy.  Dummies of all
  columns share one numbering 1, 2, ..., column after column, and a row
  carries the numbers it has: ``levels``, one for each text column, 0 for
  none.  Numeric columns are ``numbers``, with NULL and NaN as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.operators.numbering import numbered

BROADCAST_VALUES = 500_000      # a numbered table up to this size is broadcast, a larger one joined by shuffle


def quoted(name: str) -> Column:
    """The column of exactly this name (which may hold dots and backquotes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def label_text(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit("nan"))


def _sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_VALUES else table


@dataclass
class Classes:
    """The label values of real: ``table`` (``label``, ``code``) and their number."""
    table: DataFrame
    size: int

    def encode(self, df: DataFrame, target: str, name: str = "label") -> DataFrame:
        own = _sized(self.table.select(F.col("label").alias("__label"), F.col("code").alias("__code")), self.size)
        joined = df.withColumn("__text", label_text(target)).join(own, F.col("__text") == F.col("__label"), "left")
        return joined.withColumn(name, F.coalesce("__code", F.lit(0)).cast("double")).drop("__text", "__label", "__code")


def label_classes(real: DataFrame, target: str) -> Classes:
    """M3: the sorted distinct target values of real with their codes."""
    table = numbered(real.select(label_text(target).alias("label")).distinct(), [F.asc("label")], "code")
    return Classes(table, table.count())


@dataclass
class Levels:
    """The levels of real's text columns: ``table`` (``column`` number,
    ``level``, ``number`` inside the column, ``dummy``, 0 for a first level),
    their columns and how many each has."""
    table: DataFrame
    columns: list[str]
    sizes: list[int]

    @property
    def dummies(self) -> int:
        return sum(max(0, n - 1) for n in self.sizes)

    def first_dummies(self) -> list[int]:
        """The first dummy of each column."""
        out, at = [], 1
        for n in self.sizes:
            out.append(at)
            at += max(0, n - 1)
        return out

    def encode(self, df: DataFrame, nums: list[str], carry: list[str]) -> DataFrame:
        """``carry`` with ``numbers`` and ``levels`` of each row."""
        for j, (c, n) in enumerate(zip(self.columns, self.sizes)):
            own = self.table.where(F.col("column") == j).select(F.col("level").alias(f"__v{j}"), F.col("dummy").alias(f"__d{j}"))
            df = df.join(_sized(own, n), quoted(c).cast("string") == F.col(f"__v{j}"), "left")
        number = [F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in nums]
        level = [F.coalesce(f"__d{j}", F.lit(0)).cast("int") for j in range(len(self.columns))]
        return df.select(*[quoted(c) for c in carry], F.array(*number).cast("array<double>").alias("numbers"),
                         F.array(*level).cast("array<int>").alias("levels"))


def category_levels(real: DataFrame, columns: list[str]) -> Levels:
    """M5: the sorted non-null levels of each text column of real."""
    if not columns:
        empty = real.sparkSession.createDataFrame([], "column int, level string, number long, dummy long")
        return Levels(empty, [], [])
    each = F.array(*[F.struct(F.lit(j).alias("column"), quoted(c).cast("string").alias("level"))
                     for j, c in enumerate(columns)])
    distinct = real.select(F.explode(each).alias("e")).select("e.*").where("level IS NOT NULL").distinct()
    table = numbered(distinct, [F.asc("column"), F.asc("level")])
    count = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}      # one row a column
    sizes = [count.get(j, 0) for j in range(len(columns))]
    out = Levels(table, list(columns), sizes)
    before = F.array(*[F.lit(sum(sizes[:j])).cast("long") for j in range(len(sizes))])
    first = F.array(*[F.lit(d).cast("long") for d in out.first_dummies()])
    number = F.col("position") - F.element_at(before, F.col("column") + 1)
    dummy = F.when(F.col("number") > 0, F.element_at(first, F.col("column") + 1) + F.col("number") - 1).otherwise(0)
    out.table = table.select("column", "level", number.alias("number")).withColumn("dummy", dummy)
    return out


def dummy_name(col: str, number: int) -> str:
    """By the level's position: two levels may differ in punctuation only."""
    return f"{col}__{number}"


def wide_design(df: DataFrame, key: str, nums: list[str], levels: Levels) -> DataFrame:
    """The dummies as columns ``<column>__<number>``, for tables that have few."""
    rows = levels.encode(df, nums, [key])
    out = [quoted(key)] + [F.element_at("numbers", i + 1).alias(c) for i, c in enumerate(nums)]
    for j, (c, n, first) in enumerate(zip(levels.columns, levels.sizes, levels.first_dummies())):
        out += [(F.element_at("levels", j + 1) == first + i - 1).cast("int").alias(dummy_name(c, i)) for i in range(1, n)]
    return rows.select(*out)


def sparse_entries(rows: DataFrame, key: str, n_numbers: int) -> DataFrame:
    """The non-zero entries of the design: (key, ``feature``, ``value``);
    numeric columns are features 0, 1, ..., dummies follow."""
    numbers = F.transform("numbers", lambda x, i: F.struct(i.cast("long").alias("feature"), x.alias("value")))
    dummies = F.transform("levels", lambda d: F.struct(
        F.when(d > 0, (d - 1 + n_numbers).cast("long")).alias("feature"), F.lit(1.0).alias("value")))
    entries = F.filter(F.concat(numbers, dummies), lambda e: e["feature"].isNotNull() & (e["value"] != 0))
    return rows.select(key, F.explode(entries).alias("e")).select(key, "e.feature", "e.value")


def feature_kinds(real: DataFrame, leave: tuple) -> tuple[list[str], list[str]]:
    """Numeric (and boolean) columns, and the others, of real without ``leave``."""
    nums = [f.name for f in real.schema.fields
            if f.name not in leave and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return nums, [c for c in real.columns if c not in leave and c not in nums]
