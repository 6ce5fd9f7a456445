"""Queries: singling-out, linkability, CMLA and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthaudit.operators import cmla as cm
from synthaudit.operators import kmeans
from synthaudit.operators import linkability as lk
from synthaudit.operators import singling_out as so
from synthaudit.operators.results import AttackResult
from synthaudit.plans import fixtures as fx
from synthaudit.plans.catalog import oracle, query, rnd

NUMS = ["o_totalprice", "c_acctbal", "n_lines", "sum_qty", "sum_price"]
CATS = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
HALF_A = ["o_totalprice", "c_acctbal", "n_lines", "sum_qty"]
HALF_B = ["sum_price", "o_orderstatus", "o_orderpriority", "c_mktsegment"]
N_ATTACKS = 500
Z = "1.959963984540054"


def _unpivot_sql(table: str) -> str:
    parts = [f"SELECT row_key, '{c}' AS column_name, CAST({c} AS DOUBLE) AS vnum, CAST(NULL AS VARCHAR) AS vstr FROM {table}"
             for c in NUMS]
    parts += [f"SELECT row_key, '{c}' AS column_name, CAST(NULL AS DOUBLE) AS vnum, CAST({c} AS VARCHAR) AS vstr FROM {table}"
              for c in CATS]
    return " UNION ALL ".join(parts)


def _risk_sql(name: str, n: str, s: str, c: str) -> str:
    """Residual risk with Wilson intervals, same arithmetic as functions.risk."""
    return f"""
, w AS (SELECT CAST({n} AS DOUBLE) AS n, CAST({s} AS DOUBLE) AS s, CAST({c} AS DOUBLE) AS c, {Z} AS z)
, w2 AS (SELECT *, (s + z * z / 2.0) / (n + z * z) AS a,
               z / (n + z * z) * sqrt(s * (n - s) / n + z * z / 4.0) AS ea,
               (c + z * z / 2.0) / (n + z * z) AS cr,
               z / (n + z * z) * sqrt(c * (n - c) / n + z * z / 4.0) AS ec FROM w)
, w3 AS (SELECT *, (a - cr) / (1.0 - cr) AS r,
               sqrt(pow(ea / (1.0 - cr), 2) + pow((a - 1.0) / pow(1.0 - cr, 2) * ec, 2)) AS er FROM w2)
SELECT '{name}' AS attack_name, CAST(n AS BIGINT) AS n_attacks_run, CAST(s AS BIGINT) AS n_success,
       CAST(c AS BIGINT) AS n_control_success,
       round(least(1.0, greatest(0.0, r)), 6) AS risk_score,
       round(least(1.0, greatest(0.0, r - er)), 6) AS ci_lower,
       round(least(1.0, greatest(0.0, r + er)), 6) AS ci_upper FROM w3"""


def _attack_frame(spark, r: AttackResult):
    return spark.createDataFrame(
        [(r.attack_name, int(r.n_attacks_run), int(r.n_success or 0), int(r.n_control_success or 0),
          float(r.risk_score), float(r.ci_lower), float(r.ci_upper))],
        "attack_name string, n_attacks_run bigint, n_success bigint, n_control_success bigint, "
        "risk_score double, ci_lower double, ci_upper double").select(
        "attack_name", "n_attacks_run", "n_success", "n_control_success",
        rnd("risk_score").alias("risk_score"), rnd("ci_lower").alias("ci_lower"), rnd("ci_upper").alias("ci_upper"))


# ---------------------------------------------------------------- singling-out
SO_CTE = f"""
, sv AS ({_unpivot_sql('f_syn')})
, vc AS (SELECT column_name, vnum, vstr, count(*) AS n, min(row_key) AS min_key FROM sv GROUP BY column_name, vnum, vstr)
, bnd AS (SELECT column_name, min(vnum) AS lo, max(vnum) AS hi FROM sv WHERE vnum IS NOT NULL GROUP BY column_name)
, preds AS (
  SELECT column_name, 'eq' AS kind, vnum, vstr, min_key AS syn_key FROM vc
   WHERE n = 1 AND NOT (vnum IS NULL AND vstr IS NULL)
  UNION ALL SELECT column_name, 'null', vnum, vstr, min_key FROM vc WHERE n = 1 AND vnum IS NULL AND vstr IS NULL
  UNION ALL SELECT vc.column_name, 'le', vc.vnum, vc.vstr, vc.min_key FROM vc JOIN bnd ON vc.column_name = bnd.column_name AND vc.vnum = bnd.lo WHERE n = 1
  UNION ALL SELECT vc.column_name, 'ge', vc.vnum, vc.vstr, vc.min_key FROM vc JOIN bnd ON vc.column_name = bnd.column_name AND vc.vnum = bnd.hi WHERE n = 1)
, chosen AS (SELECT * FROM preds
   ORDER BY md5('42|' || column_name || '|' || kind || '|' || CAST(syn_key AS VARCHAR)), column_name, kind, syn_key
   LIMIT {N_ATTACKS})
, tv AS ({_unpivot_sql('f_train')})
, cv AS ({_unpivot_sql('f_control')})
, hit_t AS (SELECT ch.column_name, ch.kind, ch.syn_key, count(tv.row_key) AS n_match FROM chosen ch LEFT JOIN tv
   ON tv.column_name = ch.column_name AND (CASE ch.kind
        WHEN 'eq' THEN tv.vnum IS NOT DISTINCT FROM ch.vnum AND tv.vstr IS NOT DISTINCT FROM ch.vstr
        WHEN 'null' THEN tv.vnum IS NULL AND tv.vstr IS NULL
        WHEN 'le' THEN tv.vnum <= ch.vnum ELSE tv.vnum >= ch.vnum END)
   GROUP BY ch.column_name, ch.kind, ch.syn_key)
, hit_c AS (SELECT ch.column_name, ch.kind, ch.syn_key, count(cv.row_key) AS n_match FROM chosen ch LEFT JOIN cv
   ON cv.column_name = ch.column_name AND (CASE ch.kind
        WHEN 'eq' THEN cv.vnum IS NOT DISTINCT FROM ch.vnum AND cv.vstr IS NOT DISTINCT FROM ch.vstr
        WHEN 'null' THEN cv.vnum IS NULL AND cv.vstr IS NULL
        WHEN 'le' THEN cv.vnum <= ch.vnum ELSE cv.vnum >= ch.vnum END)
   GROUP BY ch.column_name, ch.kind, ch.syn_key)
"""


@query("singling_out_risk", oracle(SO_CTE + _risk_sql(
    "SinglingOut", "(SELECT count(*) FROM chosen)", "(SELECT count(*) FROM hit_t WHERE n_match = 1)",
    "(SELECT count(*) FROM hit_c WHERE n_match = 1)")))
def singling_out_risk(spark, d):
    train, syn, ctl = fx.three_way(spark, d)
    return _attack_frame(spark, so.singling_out(train, syn, ctl, fx.KEY, N_ATTACKS))


@query("singling_out_predicates", oracle(SO_CTE + """
SELECT column_name, kind, CAST(count(*) AS BIGINT) AS n_predicates FROM preds GROUP BY column_name, kind"""))
def singling_out_predicates(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    cols = [c for c in train.columns if c != fx.KEY]
    return so.predicates(syn, fx.KEY, cols).groupBy("column_name", "kind").agg(
        F.count(F.lit(1)).alias("n_predicates"))


@query("singling_out_matches", oracle(f"""
, sv AS ({_unpivot_sql('f_syn')})
, tv AS ({_unpivot_sql('f_train')})
, cv AS ({_unpivot_sql('f_control')})
, su AS (SELECT column_name, vnum, vstr FROM sv GROUP BY column_name, vnum, vstr
         HAVING count(*) = 1 AND NOT (vnum IS NULL AND vstr IS NULL))
, tu AS (SELECT column_name, vnum, vstr FROM tv GROUP BY column_name, vnum, vstr HAVING count(*) = 1)
, cu AS (SELECT column_name, vnum, vstr FROM cv GROUP BY column_name, vnum, vstr HAVING count(*) = 1)
SELECT su.column_name, CAST(count(*) AS BIGINT) AS n_predicates, CAST(count(tu.column_name) AS BIGINT) AS hits_train,
       CAST(count(cu.column_name) AS BIGINT) AS hits_control
FROM su
LEFT JOIN tu ON su.column_name = tu.column_name AND su.vnum IS NOT DISTINCT FROM tu.vnum AND su.vstr IS NOT DISTINCT FROM tu.vstr
LEFT JOIN cu ON su.column_name = cu.column_name AND su.vnum IS NOT DISTINCT FROM cu.vnum AND su.vstr IS NOT DISTINCT FROM cu.vstr
GROUP BY su.column_name"""))
def singling_out_matches(spark, d):
    train, syn, ctl = fx.three_way(spark, d)
    return so.singling_out_matches(train, syn, ctl, fx.KEY)


# ---------------------------------------------------------------- linkability
def _gower_num(c: str) -> str:
    return (f"(CASE WHEN t.{c} IS NULL AND s.{c} IS NULL THEN 0.0 WHEN t.{c} IS NULL OR s.{c} IS NULL THEN 1.0 "
            f"WHEN rg.{c} = 0 THEN 0.0 ELSE abs(t.{c} - s.{c}) / rg.{c} END)")


def _gower_cat(c: str) -> str:
    return (f"(CASE WHEN t.{c} IS NULL AND s.{c} IS NULL THEN 0.0 WHEN t.{c} IS NULL OR s.{c} IS NULL THEN 1.0 "
            f"WHEN t.{c} = s.{c} THEN 0.0 ELSE 1.0 END)")


def _gower(cols):
    return " + ".join(_gower_num(c) if c in NUMS else _gower_cat(c) for c in cols)


def _links_sql(target_table: str, name: str) -> str:
    rng_cols = ", ".join(
        f"greatest((SELECT max({c}) FROM f_syn), (SELECT max({c}) FROM {name}_t)) - "
        f"least((SELECT min({c}) FROM f_syn), (SELECT min({c}) FROM {name}_t)) AS {c}" for c in NUMS)
    return f"""
, {name}_t AS (SELECT * FROM {target_table} ORDER BY md5('42|' || CAST(row_key AS VARCHAR)), row_key LIMIT {N_ATTACKS})
, {name}_rg AS (SELECT {rng_cols})
, {name}_d AS (SELECT t.row_key AS target_key, s.row_key AS syn_key,
       {_gower(HALF_A)} AS da, {_gower(HALF_B)} AS db
   FROM {name}_t t CROSS JOIN f_syn s CROSS JOIN {name}_rg rg)
, {name}_a AS (SELECT target_key, syn_key AS nn_key_a FROM (SELECT *, row_number() OVER
      (PARTITION BY target_key ORDER BY da, syn_key) AS rn FROM {name}_d) WHERE rn = 1)
, {name}_b AS (SELECT target_key, syn_key AS nn_key_b FROM (SELECT *, row_number() OVER
      (PARTITION BY target_key ORDER BY db, syn_key) AS rn FROM {name}_d) WHERE rn = 1)
, {name}_l AS (SELECT '{name}' AS target_set, target_key, nn_key_a, nn_key_b, nn_key_a = nn_key_b AS linked
   FROM {name}_a JOIN {name}_b USING (target_key))
"""


LINK_CTE = _links_sql("f_train", "train") + _links_sql("f_control", "control")


@query("linkability_links", oracle(LINK_CTE + "SELECT * FROM train_l UNION ALL SELECT * FROM control_l"))
def linkability_links(spark, d):
    train, syn, ctl = fx.three_way(spark, d)
    return lk.linkability(train, syn, ctl, fx.KEY, N_ATTACKS, detail=True).select(
        "target_set", "target_key", "nn_key_a", "nn_key_b", "linked")


@query("linkability_risk", oracle(LINK_CTE + _risk_sql(
    "Linkability", "(SELECT count(*) FROM train_t)", "(SELECT count(*) FROM train_l WHERE linked)",
    "(SELECT count(*) FROM control_l WHERE linked)")))
def linkability_risk(spark, d):
    train, syn, ctl = fx.three_way(spark, d)
    return _attack_frame(spark, lk.linkability(train, syn, ctl, fx.KEY, N_ATTACKS))


# ---------------------------------------------------------------- CMLA
def _z(c: str) -> str:
    return f"(coalesce({c}, 0) - st.m_{c}) / (CASE WHEN st.s_{c} > 0 THEN st.s_{c} ELSE 1.0 END) AS {c}"


def _eu(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in NUMS) + ")"


def _cmla_cte(self_excluded: bool = True) -> str:
    stats = ", ".join(f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}" for c in NUMS)
    zs = ", ".join(_z(c) for c in NUMS)
    cond = "p.row_key <> q.row_key" if self_excluded else "TRUE"
    return f"""
, st AS (SELECT {stats} FROM f_train)
, zr AS (SELECT row_key, o_orderstatus AS cluster, {zs} FROM f_train, st)
, zsy AS (SELECT row_key, {zs} FROM f_syn, st)
, cen AS (SELECT cluster, {", ".join(f"avg({c}) AS {c}" for c in NUMS)} FROM zr GROUP BY cluster)
, dc AS (SELECT zr.cluster, zr.row_key, {_eu('zr', 'cen')} AS dist FROM zr JOIN cen ON zr.cluster = cen.cluster)
, dmin AS (SELECT cluster, min(dist) AS dist FROM dc GROUP BY cluster)
, med AS (SELECT dc.cluster, min(dc.row_key) AS row_key, min(dc.dist) AS dist FROM dc
          JOIN dmin ON dc.cluster = dmin.cluster AND dc.dist = dmin.dist GROUP BY dc.cluster)
, medv AS (SELECT zr.* FROM zr JOIN med ON zr.row_key = med.row_key)
, probes AS (SELECT * FROM zr ORDER BY md5('42|' || CAST(row_key AS VARCHAR)), row_key LIMIT 500)
, cal AS (SELECT p.row_key AS probe_key, min({_eu('p', 'q')}) AS dist FROM probes p JOIN zr q ON {cond}
          GROUP BY p.row_key)
, thr AS (SELECT quantile_cont(dist, 0.05) AS t FROM cal)
, sd AS (SELECT zsy.row_key, min({_eu('zsy', 'medv')}) AS dist FROM zsy CROSS JOIN medv GROUP BY zsy.row_key)
, leak AS (SELECT CAST(count(*) FILTER (WHERE dist < (SELECT t FROM thr)) AS BIGINT) AS n_leaking,
                  CAST(count(*) AS BIGINT) AS n_syn FROM sd)
"""


CMLA_CTE = _cmla_cte(True)


def _cmla_detail(spark, d, calibration="nearest_other"):
    train, syn, _ctl = fx.three_way(spark, d)
    return cm.cmla(train, syn, fx.KEY, labels="o_orderstatus", calibration=calibration, detail=True)


def _cmla_frame(spark, det):
    n_leak, n_syn = det["n_leaking"], det["n_syn"]
    asr = n_leak / n_syn if n_syn else 0.0
    return spark.createDataFrame(
        [("CMLA", int(det["k"]), float(det["threshold"]), n_leak, n_syn, asr,
          max(0.0, asr - 0.02), min(1.0, asr + 0.02))],
        "attack_name string, k bigint, threshold double, n_leaking bigint, n_syn bigint, "
        "risk_score double, ci_lower double, ci_upper double").select(
        "attack_name", "k", rnd("threshold").alias("threshold"), "n_leaking", "n_syn",
        rnd("risk_score").alias("risk_score"), rnd("ci_lower").alias("ci_lower"), rnd("ci_upper").alias("ci_upper"))


_CMLA_SELECT = """
SELECT 'CMLA' AS attack_name, CAST((SELECT count(*) FROM cen) AS BIGINT) AS k, round((SELECT t FROM thr), 6) AS threshold,
       n_leaking, n_syn, round(n_leaking / n_syn, 6) AS risk_score,
       round(greatest(0.0, n_leaking / n_syn - 0.02), 6) AS ci_lower,
       round(least(1.0, n_leaking / n_syn + 0.02), 6) AS ci_upper FROM leak"""


@query("cmla_risk_labeled", oracle(CMLA_CTE + _CMLA_SELECT))
def cmla_risk_labeled(spark, d):
    return _cmla_frame(spark, _cmla_detail(spark, d))


@query("cmla_risk_literal", oracle(_cmla_cte(False) + _CMLA_SELECT))
def cmla_risk_literal(spark, d):
    return _cmla_frame(spark, _cmla_detail(spark, d, "literal"))


@query("cmla_risk_kmeans")
def cmla_risk_kmeans(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    return _cmla_frame(spark, cm.cmla(train, syn, fx.KEY, n_clusters=10, detail=True))


@query("zscore_scale", oracle(CMLA_CTE + "SELECT row_key, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in NUMS) + " FROM zr"))
def zscore_scale(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    zr, _zs, cols = cm.scaled(train, syn, fx.KEY)
    return zr.select(fx.KEY, *[rnd(c).alias(c) for c in cols])


@query("cluster_centroids", oracle(CMLA_CTE + "SELECT cluster, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in NUMS) + " FROM cen"))
def cluster_centroids(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    zr, _zs, cols = cm.scaled(train, syn, fx.KEY)
    zr = zr.join(train.select(fx.KEY, F.col("o_orderstatus").alias("cluster")), fx.KEY)
    return cm.centroids(zr, cols).select("cluster", *[rnd(c).alias(c) for c in cols])


@query("cluster_medoids", oracle(CMLA_CTE + "SELECT cluster, row_key, round(dist, 6) AS dist FROM med"))
def cluster_medoids(spark, d):
    det = _cmla_detail(spark, d)
    return det["medoids"].select("cluster", fx.KEY, rnd("dist").alias("dist"))


@query("nn_distance_real_real", oracle(CMLA_CTE + "SELECT probe_key, round(dist, 6) AS dist FROM cal"))
def nn_distance_real_real(spark, d):
    det = _cmla_detail(spark, d)
    return det["calibration"].select("probe_key", rnd("dist").alias("dist"))


@query("distance_percentile", oracle(CMLA_CTE + "SELECT round(t, 6) AS threshold FROM thr"))
def distance_percentile(spark, d):
    det = _cmla_detail(spark, d)
    return det["calibration"].agg(rnd(F.percentile("dist", 0.05)).alias("threshold"))


@query("nn_distance_syn_medoid", oracle(CMLA_CTE + "SELECT row_key, round(dist, 6) AS dist FROM sd"))
def nn_distance_syn_medoid(spark, d):
    det = _cmla_detail(spark, d)
    return det["distances"].select(fx.KEY, rnd("dist").alias("dist"))


@query("cmla_leak_rate", oracle(CMLA_CTE + "SELECT n_leaking, n_syn, round(n_leaking / n_syn, 6) AS leak_rate FROM leak"))
def cmla_leak_rate(spark, d):
    det = _cmla_detail(spark, d)
    thr = det["threshold"]
    return det["distances"].agg(
        F.count_if(F.col("dist") < F.lit(thr)).alias("n_leaking"), F.count(F.lit(1)).alias("n_syn")).select(
        "n_leaking", "n_syn", rnd(F.col("n_leaking") / F.col("n_syn")).alias("leak_rate"))


# Given start centres (n_lines, sum_qty) for the rounds that SQL follows.
KMEANS_START = [(1.0, 20.0), (4.0, 100.0), (7.0, 220.0)]
KMEANS_ROUNDS = 3


def _nearest_sql(r: int) -> str:
    return (f"SELECT p.row_key, p.n_lines, p.sum_qty, arg_min(c.i, (p.n_lines - c.x) * (p.n_lines - c.x) "
            f"+ (p.sum_qty - c.y) * (p.sum_qty - c.y)) AS i "
            f"FROM f_train p CROSS JOIN (SELECT * FROM km{r} ORDER BY i) c GROUP BY ALL")


_KM = ", km0(i, x, y) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(KMEANS_START)) + ")"
for _r in range(KMEANS_ROUNDS):
    _KM += (f", kn{_r} AS ({_nearest_sql(_r)}), km{_r + 1} AS (SELECT k.i, coalesce(avg(n.n_lines), any_value(k.x)) AS x, "
            f"coalesce(avg(n.sum_qty), any_value(k.y)) AS y FROM km{_r} k LEFT JOIN kn{_r} n USING (i) GROUP BY k.i)")


@query("kmeans_rounds", oracle(_KM + f", last AS ({_nearest_sql(KMEANS_ROUNDS)}) SELECT CAST(k.i AS INTEGER) AS cluster, "
       "round(any_value(k.x), 6) AS n_lines, round(any_value(k.y), 6) AS sum_qty, CAST(count(l.row_key) AS BIGINT) AS n_rows "
       f"FROM km{KMEANS_ROUNDS} k LEFT JOIN last l USING (i) GROUP BY k.i"))
def kmeans_rounds(spark, d):
    """Centres and sizes after a fixed number of rounds from given centres."""
    train, _syn, _ctl = fx.three_way(spark, d)
    cols = ["n_lines", "sum_qty"]
    cent, _rounds, _done = kmeans.fit_report(train, fx.KEY, cols, len(KMEANS_START), max_iter=KMEANS_ROUNDS,
                                             start=KMEANS_START)
    sizes = kmeans.assign(train, cols, cent).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows"))
    centres = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(cent)],
                                    "cluster int, n_lines double, sum_qty double")
    return centres.join(sizes, "cluster", "left").select(
        "cluster", rnd("n_lines").alias("n_lines"), rnd("sum_qty").alias("sum_qty"),
        F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))
