"""JSON safety and tolerant JSON read (S8, S9), summary sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _safe(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None).cast(dt)).otherwise(c)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: _safe(e, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _k, v: _safe(v, dt.valueType))
    if isinstance(dt, T.StructType):
        fields = [_safe(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]
        return F.when(c.isNull(), F.lit(None).cast(dt)).otherwise(F.struct(*fields))
    return c


def has_float(dt: T.DataType) -> bool:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(dt, T.ArrayType):
        return has_float(dt.elementType)
    if isinstance(dt, T.MapType):
        return has_float(dt.valueType)
    if isinstance(dt, T.StructType):
        return any(has_float(f.dataType) for f in dt.fields)
    return False


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and ±Infinity become NULL at any depth (Spark's ``to_json``
    would write them as strings, which is not valid JSON for numbers)."""
    return df.select(*[(_safe(F.col(f.name), f.dataType) if has_float(f.dataType) else F.col(f.name)).alias(f.name)
                       for f in df.schema.fields])


def read_json_text(df: DataFrame, col: str, schema, name: str = "parsed") -> DataFrame:
    """Parse JSON text that may contain NaN / Infinity tokens; those
    values become NULL."""
    parsed = df.withColumn(name, F.from_json(F.col(col), schema, {"allowNonNumericNumbers": "true"}))
    return json_safe(parsed)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON document per summary row, written as text."""
    (json_safe(summary).select(F.to_json(F.struct("*")).alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))
