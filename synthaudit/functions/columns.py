"""Schema helpers: which columns are features, numeric, categorical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def feature_columns(df: DataFrame, key: str | None = None) -> list[str]:
    return [c for c in df.columns if c != key]


def is_numeric_type(dt: T.DataType, include_bool: bool = False) -> bool:
    if isinstance(dt, T.BooleanType):
        return include_bool
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, key: str | None = None, include_bool: bool = False) -> list[str]:
    """Numeric feature columns in table order (bool only on request: R7/R9)."""
    return [f.name for f in df.schema.fields
            if f.name != key and is_numeric_type(f.dataType, include_bool)]


def categorical_columns(df: DataFrame, key: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name != key and isinstance(f.dataType, T.StringType)]


TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_time_type(dt: T.DataType) -> bool:
    return isinstance(dt, TIME_TYPES)


def time_to_number(c: str, dt: T.DataType):
    """Zone-free numeric encoding: microseconds (timestamps) or days (dates)."""
    from pyspark.sql import functions as F

    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(c)).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)").cast("double")
    return F.unix_micros(F.col(c)).cast("double")


def number_to_time(c: str, dt: T.DataType):
    """Inverse of :func:`time_to_number` (rounded to whole units)."""
    from pyspark.sql import functions as F

    n = F.round(F.col(c)).cast("long")
    if isinstance(dt, T.DateType):
        return F.date_from_unix_date(n.cast("int"))
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampadd(MICROSECOND, CAST(round(`{c}`) AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return F.timestamp_micros(n)
