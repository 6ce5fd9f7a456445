"""Profiling: the data-dependent part of cleaning.

One aggregate action produces a :class:`CleaningPlan`; applying the plan is
lazy (see ``clean.py``).  Distinct counts use a HyperLogLog screen and are
made exact only for columns whose estimate is near a decision threshold.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthaudit.config import LoaderConfig

# Accepted date/time text formats of the datetime probe.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy")
log = logging.getLogger(__name__)
HLL_RSD = 0.02          # relative error of the screen
NEAR = 0.10             # "near a threshold" margin for exact recounts
PROBE_ROWS = 5          # first non-null values tested by the datetime probe
PROBE_HEAD = 20         # rows that are looked at for them in one pass over all columns

SIMPLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_categorical(dt: T.DataType) -> bool:
    """String columns."""
    return isinstance(dt, T.StringType)


def is_numeric(dt: T.DataType) -> bool:
    """Numeric, bool counts as numeric."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_other(dt: T.DataType) -> bool:
    return not isinstance(dt, SIMPLE)


def parse_any(c):
    """First format that parses the text, else NULL (ANSI-safe)."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS])


def id_like(name: str, cfg: LoaderConfig) -> bool:
    """Lower-case name contains a pattern (decision D5: substring by
    default, whole ``_``-separated tokens with ``id_match="token"``)."""
    low = name.lower()
    if cfg.id_match == "token":
        toks = low.replace("-", "_").split("_")
        for p in cfg.drop_id_patterns:
            pt = p.strip("_").split("_")
            if any(toks[i:i + len(pt)] == pt for i in range(len(toks) - len(pt) + 1)):
                return True
        return False
    return any(p in low for p in cfg.drop_id_patterns)


def drop_null_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Drop rows whose feature columns are all NULL."""
    cols = [c for c in df.columns if c != key]
    return df.na.drop("all", subset=cols)


def null_counts(df: DataFrame, key: str | None = None) -> DataFrame:
    """``(column, n_null)`` for every column, one pass."""
    cols = [c for c in df.columns if c != key]
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"))
                    for c in cols])
    return df.agg(arr.alias("a")).select(F.inline("a"))


def exact_distinct(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    r = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    return {c: int(r[f"d{i}"]) for i, c in enumerate(cols)}


def datetime_probe(df: DataFrame, key: str, cols: list[str]) -> dict:
    """R8 for text columns: the first ≤5 non-null values by key all parse.
    One top-k of a few rows answers for every column that has five values
    there; only a column with many gaps at the start takes one of its own."""
    if not cols:
        return {}
    head = df.select(key, *[F.col(f"`{c}`") for c in cols]).orderBy(key).limit(PROBE_HEAD)
    rows = head.select(*[F.when(F.col(f"`{c}`").isNotNull(), parse_any(F.col(f"`{c}`")).isNotNull()).alias(f"p{i}")
                         for i, c in enumerate(cols)]).collect()
    out = {}
    for i, c in enumerate(cols):
        vals = [r[f"p{i}"] for r in rows if r[f"p{i}"] is not None][:PROBE_ROWS]
        if len(vals) < PROBE_ROWS and len(rows) == PROBE_HEAD:
            own = df.where(F.col(f"`{c}`").isNotNull()).orderBy(key).limit(PROBE_ROWS)
            vals = [v["ok"] for v in own.select(parse_any(F.col(f"`{c}`")).isNotNull().alias("ok")).collect()]
        out[c] = bool(vals) and all(vals)
    return out


@dataclass
class ColumnInfo:
    name: str
    spark_type: str
    kind: str            # datetime | categorical | numeric | other
    n_null: int
    approx_distinct: int
    distinct: int | None = None


@dataclass
class CleaningPlan:
    key: str | None
    n_rows: int                     # after R1 (G1 "original")
    n_cols: int
    all_null: list = field(default_factory=list)
    id_cols: list = field(default_factory=list)
    high_card: list = field(default_factory=list)
    ratios: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)   # name -> ColumnInfo (survivors)

    @property
    def dropped(self) -> list:
        return self.all_null + self.id_cols + self.high_card


def profile(df: DataFrame, key: str | None = None, cfg: LoaderConfig | None = None) -> CleaningPlan:
    """Action: one aggregate of row count, null counts and HLL distinct
    estimates over ``df`` (already without all-null rows), then exact
    recounts near thresholds and the datetime probe for text columns."""
    cfg = cfg or LoaderConfig()
    cols = [c for c in df.columns if c != key]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"z{i}"),
                 F.approx_count_distinct(F.col(c), HLL_RSD).alias(f"a{i}")]
    r = df.agg(*aggs).first()
    n = int(r["__n"])
    plan = CleaningPlan(key, n, len(cols))
    info = {}
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        nz = int(r[f"z{i}"])
        if nz == n:
            plan.all_null.append(c)                       # R2
            continue
        info[c] = ColumnInfo(c, dt.simpleString(), "", nz, int(r[f"a{i}"]))
    # R3 then R4, in column order (a column dropped by R3 is not tested by R4)
    text = [c for c, ci in info.items() if is_categorical(df.schema[c].dataType)]
    cands = [c for c in text if not id_like(c, cfg)]
    near = [c for c in cands if abs(info[c].approx_distinct / max(n, 1) - cfg.high_cardinality_threshold)
            <= NEAR or info[c].approx_distinct <= 20]
    exact = exact_distinct(df, near)
    for c in list(info):
        if id_like(c, cfg):
            plan.id_cols.append(c)
            del info[c]
            continue
        if c in cands:
            d = exact.get(c, info[c].approx_distinct)
            info[c].distinct = exact.get(c)
            ratio = d / n if n else 0.0
            plan.ratios[c] = ratio
            if ratio > cfg.high_cardinality_threshold:
                plan.high_card.append(c)
                del info[c]
    # kinds of the survivors (R8 before R6, as the original tool)
    probe = datetime_probe(df, key, [c for c in info if is_categorical(df.schema[c].dataType)]) if key else {}
    for c, ci in info.items():
        dt = df.schema[c].dataType
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) or probe.get(c):
            ci.kind = "datetime"
        elif is_categorical(dt) or (isinstance(dt, T.BooleanType) and ci.n_null > 0):
            ci.kind = "categorical"      # a boolean with gaps has a mode, not a median
        elif is_numeric(dt):
            ci.kind = "numeric"
        else:
            ci.kind = "other"
    plan.columns = info
    return plan


def semantic_type(df: DataFrame, key: str | None = None, overrides: dict | None = None) -> DataFrame:
    """``(column, spark_type, sdtype, n_rows, n_null)``.

    boolean → boolean; datetime type or text passing the probe → datetime;
    integral with all values distinct → id; integral with ≤ min(rows/10, 10)
    distinct → categorical; other numeric → numerical; text with all values
    distinct → id; else categorical.  Overrides replace the inferred type;
    unknown override columns are ignored (a warning, not an error).
    """
    cols = [c for c in df.columns if c != key]
    for c in (overrides or {}):
        if c not in cols:
            log.warning("no column '%s' to override", c)      # R19: warn, not fail
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.approx_count_distinct(F.col(c), HLL_RSD).alias(f"a{i}")]
    r = df.agg(*aggs).first()
    n = int(r["__n"])
    # exact distinct only where a rule is decided near its threshold
    need = []
    for i, c in enumerate(cols):
        a, nn = int(r[f"a{i}"]), n - int(r[f"z{i}"])
        if a <= 20 or abs(a - nn) <= NEAR * max(nn, 1):
            need.append(c)
    exact = exact_distinct(df, need)
    text = [c for c in cols if is_categorical(df.schema[c].dataType)]
    probe = datetime_probe(df, key, text) if key else {}
    rows = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        nn = n - int(r[f"z{i}"])
        d = exact.get(c, int(r[f"a{i}"]))
        if isinstance(dt, T.BooleanType):
            st = "boolean"
        elif isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) or probe.get(c):
            st = "datetime"
        elif isinstance(dt, T.IntegralType):
            st = "id" if d == nn else ("categorical" if d <= min(n / 10.0, 10) else "numerical")
        elif isinstance(dt, T.NumericType):
            st = "numerical"
        elif is_categorical(dt):
            st = "id" if d == nn else "categorical"
        else:
            st = "other"
        if overrides and c in overrides:
            st = overrides[c]
        rows.append((c, dt.simpleString(), st, n, int(r[f"z{i}"])))
    return df.sparkSession.createDataFrame(
        rows, "column string, spark_type string, sdtype string, n_rows bigint, n_null bigint")


def apply_types(df: DataFrame, overrides: dict) -> DataFrame:
    """R19 for what follows: a column declared categorical becomes text,
    numerical a double, datetime a timestamp (values that do not convert
    become NULL); other declarations and unknown columns change nothing."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), overrides.get(f.name)
        if kind == "categorical" and not is_categorical(f.dataType):
            c = c.cast("string")
        elif kind == "numerical" and not isinstance(f.dataType, T.NumericType):
            c = c.try_cast("double")
        elif kind == "datetime" and is_categorical(f.dataType):
            c = parse_any(c)
        out.append(c.alias(f.name))
    for name in overrides:
        if name not in df.columns:
            log.warning("no column '%s' to override", name)
    return df.select(*out)
