"""Queries: profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthaudit.config import LoaderConfig
from synthaudit.operators import clean as cl
from synthaudit.operators import profile as pf
from synthaudit.plans import fixtures as fx
from synthaudit.plans.catalog import query, rnd
from synthaudit.plans.run import with_long_key
from synthaudit.session import session_key

K = fx.RAW_KEY
RAW_FEATURES = ["event_id", "ts", "day_text", "event_type", "value", "props", "user_name", "empty_col", "width"]
_CACHE: dict = {}


def cleaned(spark, d):
    k = (session_key(spark), d)
    if k not in _CACHE:
        _CACHE[k] = cl.load_and_clean(fx.raw_events(spark, d), K)
    return _CACHE[k]


def _micros(c: str):
    """Microseconds since the epoch of a wall-clock timestamp, independent of
    the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{c}` AS TIMESTAMP_NTZ))")


def _sql(body: str) -> str:
    return fx.ORACLE_RAW + body


@query("drop_null_rows", _sql("""SELECT CAST((SELECT count(*) FROM raw) AS BIGINT) AS n_before,
  CAST((SELECT count(*) FROM r1) AS BIGINT) AS n_after"""))
def drop_null_rows(spark, d):
    raw = fx.raw_events(spark, d)
    kept = pf.drop_null_rows(raw, K)
    return raw.agg(F.count(F.lit(1)).alias("n_before")).select(
        "n_before", F.lit(kept.count()).cast("long").alias("n_after"))


@query("null_counts", _sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM r1"
    for c in RAW_FEATURES)))
def null_counts(spark, d):
    return pf.null_counts(pf.drop_null_rows(fx.raw_events(spark, d), K), K)


@query("drop_null_cols", _sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column FROM r1 HAVING count({c}) = 0" for c in RAW_FEATURES)))
def drop_null_cols(spark, d):
    return spark.createDataFrame([(c,) for c in cleaned(spark, d).plan.all_null], "column string")


@query("drop_id_cols", _sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column FROM r1 HAVING count({c}) > 0 AND (" + " OR ".join(
        f"contains(lower('{c}'), '{p}')" for p in ("id", "_id", "uuid", "index", "row_num")) + ")"
    for c in RAW_FEATURES)))
def drop_id_cols(spark, d):
    return spark.createDataFrame([(c,) for c in cleaned(spark, d).plan.id_cols], "column string")


_TEXT = ["day_text", "event_type", "props", "user_name"]


@query("high_cardinality_cols", _sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(count(DISTINCT {c}) / count(*), 6) AS ratio, count(DISTINCT {c}) / count(*) > 0.5 AS dropped FROM r1"
    for c in _TEXT)))
def high_cardinality_cols(spark, d):
    plan = cleaned(spark, d).plan
    distinct = pf.exact_distinct(pf.drop_null_rows(fx.raw_events(spark, d), K), list(plan.ratios))
    return spark.createDataFrame([(c, round(distinct[c] / plan.n_rows, 6), c in plan.high_card) for c in plan.ratios],
                                 "column string, ratio double, dropped boolean")


@query("fill_text_key", _sql("""SELECT 'e-' || CAST(row_key AS VARCHAR) AS name, epoch_us(coalesce(
  last_value(ts IGNORE NULLS) OVER (ORDER BY 'e-' || CAST(row_key AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(ts IGNORE NULLS) OVER (ORDER BY 'e-' || CAST(row_key AS VARCHAR) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS ts_us
FROM raw"""))
def fill_text_key(spark, d):
    """Gaps filled in the order of a text key, by way of the number that stands for it."""
    name = F.concat(F.lit("e-"), F.col(K).cast("string"))
    rows = fx.raw_events(spark, d).select(name.alias(K), name.alias("name"), "ts")
    numbered = with_long_key(rows, K)
    return cl.ffill_bfill(numbered, K, ["ts"]).select("name", _micros("ts").alias("ts_us"))


def _probe_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column, bool_and(TRY_CAST(trim({c}) AS TIMESTAMP) IS NOT NULL) AS is_datetime "
            f"FROM (SELECT {c} FROM r1 WHERE {c} IS NOT NULL ORDER BY row_key LIMIT 5)")


@query("datetime_probe", _sql(" UNION ALL ".join(_probe_sql(c) for c in ["day_text", "event_type", "props"])))
def datetime_probe(spark, d):
    r1 = pf.drop_null_rows(fx.raw_events(spark, d), K)
    res = pf.datetime_probe(r1, K, ["day_text", "event_type", "props"])
    return spark.createDataFrame(list(res.items()), "column string, is_datetime boolean")


@query("impute_mode", _sql("""SELECT 'event_type' AS column, (SELECT v FROM mode_et) AS fill_value,
  CAST((SELECT count(*) FROM r1 WHERE event_type IS NULL) AS BIGINT) AS n_null
UNION ALL SELECT 'event_type_filled_' || event_type, NULL, CAST(count(*) AS BIGINT) FROM cleaned GROUP BY event_type"""))
def impute_mode(spark, d):
    res = cleaned(spark, d)
    log = [r for r in res.imputation_log if r[0] == "event_type"]
    head = spark.createDataFrame([(r[0], r[2], r[3]) for r in log], "column string, fill_value string, n_null bigint")
    dist = res.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_null")).select(
        F.concat(F.lit("event_type_filled_"), F.col("event_type")).alias("column"),
        F.lit(None).cast("string").alias("fill_value"), "n_null")
    return head.unionByName(dist)


@query("impute_median", _sql("""SELECT 'value' AS column, round((SELECT m FROM med), 6) AS fill_value,
  CAST((SELECT count(*) FROM r1 WHERE value IS NULL) AS BIGINT) AS n_null,
  round((SELECT sum(value) FROM cleaned), 4) AS filled_sum"""))
def impute_median(spark, d):
    res = cleaned(spark, d)
    r1 = pf.drop_null_rows(fx.raw_events(spark, d), K)
    m = cl.exact_median(r1, "value")
    n_null = r1.where(F.col("value").isNull()).count()
    return res.df.agg(rnd(F.sum("value"), 4).alias("filled_sum")).select(
        F.lit("value").alias("column"), F.round(F.lit(m), 6).alias("fill_value"),
        F.lit(n_null).cast("long").alias("n_null"), "filled_sum")


@query("impute_ffill_bfill", _sql("SELECT row_key, epoch_us(ts) AS ts_us, day_text FROM cleaned"))
def impute_ffill_bfill(spark, d):
    return cleaned(spark, d).df.select(K, _micros("ts").alias("ts_us"), "day_text")


@query("imputation_log", _sql("""
SELECT 'ts' AS column, 'ffill+bfill' AS strategy, CAST(count(*) FILTER (WHERE ts IS NULL) AS BIGINT) AS n FROM r1
UNION ALL SELECT 'day_text', 'ffill+bfill', CAST(count(*) FILTER (WHERE day_text IS NULL) AS BIGINT) FROM r1
UNION ALL SELECT 'event_type', 'mode', CAST(count(*) FILTER (WHERE event_type IS NULL) AS BIGINT) FROM r1
UNION ALL SELECT 'value', 'median', CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) FROM r1"""))
def imputation_log(spark, d):
    return spark.createDataFrame([(c, s, n) for c, s, _v, n in cleaned(spark, d).imputation_log],
                                 "column string, strategy string, n bigint")


@query("clean_pipeline", _sql("""SELECT row_key, epoch_us(ts) AS ts_us, day_text, event_type,
  round(value, 6) AS value, props FROM cleaned"""))
def clean_pipeline(spark, d):
    df = cleaned(spark, d).df
    return df.select(K, _micros("ts").alias("ts_us"), "day_text", "event_type", rnd("value").alias("value"), "props")


@query("clean_shape", _sql("""SELECT CAST((SELECT count(*) FROM r1) AS BIGINT) AS rows_before, 9 AS cols_before,
  CAST((SELECT count(*) FROM cleaned) AS BIGINT) AS rows_after, 5 AS cols_after"""))
def clean_shape(spark, d):
    res = cleaned(spark, d)
    return spark.createDataFrame([(res.original_shape[0], res.original_shape[1], res.cleaned_shape[0],
                                   res.cleaned_shape[1])], "rows_before bigint, cols_before int, rows_after bigint, cols_after int")


_PROFILE_SQL = """
, prof AS (
  SELECT 'ts' AS column, 'datetime' AS sdtype, count(*) AS n_rows, count(*) - count(ts) AS n_null FROM cleaned
  UNION ALL SELECT 'day_text',
    CASE WHEN (SELECT bool_and(TRY_CAST(trim(day_text) AS TIMESTAMP) IS NOT NULL) FROM
               (SELECT day_text FROM cleaned WHERE day_text IS NOT NULL ORDER BY row_key LIMIT 5)) THEN 'datetime'
         WHEN count(DISTINCT day_text) = count(day_text) THEN 'id' ELSE 'categorical' END,
    count(*), count(*) - count(day_text) FROM cleaned
  UNION ALL SELECT 'event_type', CASE WHEN count(DISTINCT event_type) = count(event_type) THEN 'id' ELSE 'categorical' END,
    count(*), count(*) - count(event_type) FROM cleaned
  UNION ALL SELECT 'value', 'numerical', count(*), count(*) - count(value) FROM cleaned
  UNION ALL SELECT 'props', CASE WHEN count(DISTINCT props) = count(props) THEN 'id' ELSE 'categorical' END,
    count(*), count(*) - count(props) FROM cleaned)
"""


@query("schema_profile", _sql(_PROFILE_SQL + """SELECT "column", sdtype, CAST(n_rows AS BIGINT) AS n_rows,
  CAST(n_null AS BIGINT) AS n_null FROM prof"""))
def schema_profile(spark, d):
    return pf.semantic_type(cleaned(spark, d).df, K).select("column", "sdtype", "n_rows", "n_null")


@query("schema_override", _sql(_PROFILE_SQL + """SELECT "column",
  CASE WHEN "column" = 'value' THEN 'categorical' ELSE sdtype END AS sdtype FROM prof"""))
def schema_override(spark, d):
    ov = {"value": "categorical", "not_a_column": "numerical"}   # unknown column is ignored
    return pf.semantic_type(cleaned(spark, d).df, K, overrides=ov).select("column", "sdtype")


@query("drop_rows_subset", _sql("""SELECT CAST(count(*) AS BIGINT) AS n_rows FROM r1 WHERE value IS NOT NULL"""))
def drop_rows_subset(spark, d):
    r1 = pf.drop_null_rows(fx.raw_events(spark, d), K)
    return cl.drop_rows_null_in(r1, ["value"]).agg(F.count(F.lit(1)).alias("n_rows"))


@query("preview_head", _sql("""SELECT CAST((SELECT count(*) FROM raw) AS BIGINT) AS n_rows, row_key, event_type,
  round(value, 6) AS value FROM raw ORDER BY row_key LIMIT 5"""))
def preview_head(spark, d):
    raw = fx.raw_events(spark, d)
    n = raw.count()
    return raw.orderBy(K).limit(5).select(F.lit(n).cast("long").alias("n_rows"), K, "event_type",
                                          rnd("value").alias("value"))


def typed_orders(spark, d):
    """``orders`` with NaN, a boolean with gaps and one without, and integers."""
    k = F.col("o_orderkey")
    return fx.read_table(spark, d, "orders").select(
        k.alias(K), F.when(k % 10 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 6 != 0, F.col("o_orderstatus") == "O").alias("open"),
        F.when(k % 8 != 0, (k % 97).cast("int")).alias("level"), (k % 4 == 0).alias("steady"),
        k.alias("serial"), (k % 3).cast("int").alias("small"), F.col("o_orderpriority").alias("priority"))


TYPED_SQL = """
WITH t AS (SELECT o_orderkey AS row_key, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus = 'O' END AS open,
  CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 97 AS INTEGER) END AS level, o_orderkey % 4 = 0 AS steady,
  o_orderkey AS serial, CAST(o_orderkey % 3 AS INTEGER) AS small, o_orderpriority AS priority FROM orders)
"""


@query("clean_typed", TYPED_SQL + """
SELECT row_key, round(coalesce(price, (SELECT median(price) FROM t)), 6) AS price,
  coalesce(open, (SELECT open FROM t WHERE open IS NOT NULL GROUP BY open ORDER BY count(*) DESC, open LIMIT 1)) AS open,
  CAST(coalesce(level, (SELECT median(level) FROM t)) AS DOUBLE) AS level, steady, CAST(serial AS BIGINT) AS serial,
  CAST(small AS VARCHAR) AS small, priority FROM t""")
def clean_typed(spark, d):
    """Cleaning of NaN, booleans and integers; ``small`` is declared categorical."""
    cfg = LoaderConfig(metadata_overrides={"small": "categorical"})
    df = cl.load_and_clean(typed_orders(spark, d), K, cfg).df
    return df.select(K, rnd("price").alias("price"), "open", "level", "steady", "serial", "small", "priority")


@query("schema_types", TYPED_SQL + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CASE WHEN typeof(any_value({c})) = 'BOOLEAN' THEN 'boolean'
  WHEN typeof(any_value({c})) = 'DOUBLE' THEN 'numerical'
  WHEN typeof(any_value({c})) = 'VARCHAR' THEN CASE WHEN count(DISTINCT {c}) = count({c}) THEN 'id' ELSE 'categorical' END
  WHEN count(DISTINCT {c}) = count({c}) THEN 'id'
  WHEN count(DISTINCT {c}) <= least(count(*) / 10.0, 10) THEN 'categorical' ELSE 'numerical' END AS sdtype,
  CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM t"""
    for c in ("price", "open", "level", "steady", "serial", "small", "priority")))
def schema_types(spark, d):
    """Semantic types by every rule that depends on the stored type."""
    return pf.semantic_type(cl.nan_to_null(typed_orders(spark, d)), K).select("column", "sdtype", "n_null")
