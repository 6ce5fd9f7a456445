"""Queries: audit records, flags, scores, ranking (O2, O3, R15–R17, T5–T7,
U1, U4, G14–G16, V2).

Candidates audited against the hash split of ``facts``: ``perturbed``
(the perturbed twin of train), ``copy`` (train itself — a memorising
generator, maximal leakage) and ``truncated`` (perturbed without
``c_mktsegment``: fails the schema check, decision D10, and becomes the
fail-safe placeholder).  Clusters for CMLA are given (``o_orderstatus``)
so that DuckDB can follow every step.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from synthaudit.config import AuditConfig
from synthaudit.plans import audit as au
from synthaudit.plans import fixtures as fx
from synthaudit.plans import q_attacks as qa
from synthaudit.plans import q_utility as qu
from synthaudit.plans.catalog import oracle, query, rnd
from synthaudit.session import session_key

Z = qa.Z


def _risk_select(n: str, s: str, c: str) -> str:
    return f"""SELECT n, s, c, least(1.0, greatest(0.0, r)) AS risk, least(1.0, greatest(0.0, r - er)) AS lo,
       least(1.0, greatest(0.0, r + er)) AS hi FROM (
     SELECT *, (a - cr) / (1.0 - cr) AS r,
            sqrt(pow(ea / (1.0 - cr), 2) + pow((a - 1.0) / pow(1.0 - cr, 2) * ec, 2)) AS er FROM (
       SELECT *, (s + z * z / 2.0) / (n + z * z) AS a, z / (n + z * z) * sqrt(s * (n - s) / n + z * z / 4.0) AS ea,
              (c + z * z / 2.0) / (n + z * z) AS cr, z / (n + z * z) * sqrt(c * (n - c) / n + z * z / 4.0) AS ec
       FROM (SELECT CAST({n} AS DOUBLE) AS n, CAST({s} AS DOUBLE) AS s, CAST({c} AS DOUBLE) AS c, {Z} AS z)))"""


def _prefixed(text: str, p: str, syn_table: str) -> str:
    names = re.findall(r",\s*(\w+) AS \(", text)
    text = text.replace("f_syn", syn_table)
    for nm in sorted(set(names), key=len, reverse=True):
        text = re.sub(rf"(?<![\w.']){nm}(?=[\s.),]|$)", f"{p}_{nm}", text)
    return text


def audit_cte(syn_table: str, p: str) -> str:
    body = qa.SO_CTE + qa.LINK_CTE + qa.CMLA_CTE + qu.SIM_CTE + qu.LOGIC_SCORE_CTE
    body += f"""
, sor AS ({_risk_select("(SELECT count(*) FROM chosen)", "(SELECT count(*) FROM hit_t WHERE n_match = 1)",
                        "(SELECT count(*) FROM hit_c WHERE n_match = 1)")})
, lkr AS ({_risk_select("(SELECT count(*) FROM train_t)", "(SELECT count(*) FROM train_l WHERE linked)",
                        "(SELECT count(*) FROM control_l WHERE linked)")})
, rec AS (SELECT sor.risk AS so_risk, sor.lo AS so_lo, sor.hi AS so_hi, lkr.risk AS lk_risk, lkr.lo AS lk_lo,
                 lkr.hi AS lk_hi, leak.n_leaking / leak.n_syn AS cm_risk,
                 sim.correlation_similarity AS csim, lgs.logic_consistency AS lcons,
                 0.5 * sim.correlation_similarity + 0.5 * lgs.logic_consistency AS cutil
          FROM sor, lkr, leak, sim, lgs)
"""
    return _prefixed(body, p, syn_table)


def _record_select(model: str, p: str, order: int) -> str:
    r = f"{p}_rec"
    priv = f"(1.0 - greatest({r}.so_risk, {r}.lk_risk, {r}.cm_risk))"
    pp = f"({r}.so_risk <= 0.1 AND {r}.lk_risk <= 0.1 AND {r}.cm_risk <= 0.1)"
    up = f"(coalesce({r}.lcons >= 0.7 AND {r}.csim >= 0.7, false))"
    return f"""SELECT '{model}' AS model, round({r}.so_risk, 4) AS singling_out_risk, round({r}.so_lo, 6) AS so_ci_lower,
  round({r}.so_hi, 6) AS so_ci_upper, round({r}.lk_risk, 4) AS linkability_risk, round({r}.lk_lo, 6) AS link_ci_lower,
  round({r}.lk_hi, 6) AS link_ci_upper, round({r}.cm_risk, 4) AS cmla_risk,
  round({r}.csim, 4) AS correlation_similarity, round({r}.lcons, 4) AS logic_consistency,
  CAST(-1.0 AS DOUBLE) AS tstr_score, CAST(-1.0 AS DOUBLE) AS tstr_baseline, CAST(-1.0 AS DOUBLE) AS tstr_gap, round({r}.cutil, 4) AS composite_utility,
  round({priv}, 4) AS privacy_score, round(0.5 * {priv} + 0.5 * {r}.cutil, 4) AS composite_score,
  {pp} AS privacy_pass, {up} AS utility_pass, {pp} AND {up} AS overall_pass, {order} AS config_order
  FROM {r}"""


FAILED_SELECT = """SELECT 'truncated' AS model, CAST(1.0 AS DOUBLE) AS singling_out_risk, CAST(1.0 AS DOUBLE) AS so_ci_lower, CAST(1.0 AS DOUBLE) AS so_ci_upper,
  CAST(1.0 AS DOUBLE) AS linkability_risk, CAST(1.0 AS DOUBLE) AS link_ci_lower, CAST(1.0 AS DOUBLE) AS link_ci_upper, CAST(1.0 AS DOUBLE) AS cmla_risk,
  CAST(0.0 AS DOUBLE) AS correlation_similarity, CAST(0.0 AS DOUBLE) AS logic_consistency, CAST(-1.0 AS DOUBLE) AS tstr_score, CAST(-1.0 AS DOUBLE) AS tstr_baseline,
  CAST(-1.0 AS DOUBLE) AS tstr_gap, CAST(0.0 AS DOUBLE) AS composite_utility, CAST(0.0 AS DOUBLE) AS privacy_score, CAST(0.0 AS DOUBLE) AS composite_score,
  false AS privacy_pass, false AS utility_pass, false AS overall_pass, 2 AS config_order"""

RECORDS_CTE = (audit_cte("f_syn", "pz") + audit_cte("f_train", "cp") + ", records AS (" + _record_select("perturbed", "pz", 0)
               + " UNION ALL " + _record_select("copy", "cp", 1) + " UNION ALL " + FAILED_SELECT + ")\n")

REC_COLS = ["model", "singling_out_risk", "so_ci_lower", "so_ci_upper", "linkability_risk", "link_ci_lower",
            "link_ci_upper", "cmla_risk", "correlation_similarity", "logic_consistency", "tstr_score",
            "tstr_baseline", "tstr_gap", "composite_utility", "privacy_score", "composite_score",
            "privacy_pass", "utility_pass", "overall_pass", "config_order"]

_CACHE: dict = {}


def records(spark, d):
    """Audit records of the three candidates (computed once per session and folder)."""
    k = (session_key(spark), d)
    if k not in _CACHE:
        train, syn, ctl = fx.three_way(spark, d)
        cands = [au.Candidate("perturbed", syn), au.Candidate("copy", train),
                 au.Candidate("truncated", syn.drop("c_mktsegment"))]
        _CACHE[k] = au.audit(train, ctl, cands, fx.KEY, AuditConfig(), cluster_labels="o_orderstatus").cache()
    return _CACHE[k]


def _rec_out(df):
    out = []
    for c in REC_COLS:
        if c in ("so_ci_lower", "so_ci_upper", "link_ci_lower", "link_ci_upper"):
            out.append(rnd(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@query("audit_pair", oracle(audit_cte("f_syn", "pz") + _record_select("perturbed", "pz", 0)))
def audit_pair_q(spark, d):
    train, syn, ctl = fx.three_way(spark, d)
    real = au.RealSide(train, ctl, fx.KEY, AuditConfig(), cluster_labels="o_orderstatus")
    rec = au.audit_pair(real, syn, "perturbed", {}, 0)
    real.release()
    return _rec_out(au.records_frame(spark, [rec]))


@query("union_records", oracle(RECORDS_CTE + "SELECT * FROM records"))
def union_records(spark, d):
    return _rec_out(records(spark, d))


@query("audit_record", oracle(RECORDS_CTE + """SELECT model, singling_out_risk, linkability_risk, cmla_risk,
  composite_score, overall_pass FROM records WHERE model = 'copy'"""))
def audit_record(spark, d):
    return records(spark, d).where(F.col("model") == "copy").select(
        "model", "singling_out_risk", "linkability_risk", "cmla_risk", "composite_score", "overall_pass")


@query("threshold_flags", oracle(RECORDS_CTE + """SELECT model,
  coalesce(singling_out_risk <= 0.1 AND linkability_risk <= 0.1 AND cmla_risk <= 0.1, false) AS privacy_pass,
  coalesce(logic_consistency >= 0.7 AND correlation_similarity >= 0.7, false) AS utility_pass,
  coalesce(singling_out_risk <= 0.1 AND linkability_risk <= 0.1 AND cmla_risk <= 0.1, false)
  AND coalesce(logic_consistency >= 0.7 AND correlation_similarity >= 0.7, false) AS overall_pass FROM records"""))
def threshold_flags(spark, d):
    return au.threshold_flags(records(spark, d))


@query("composite_scores", oracle(RECORDS_CTE + """SELECT model,
  round(1.0 - greatest(singling_out_risk, linkability_risk, cmla_risk), 6) AS privacy_score,
  round(CASE WHEN tstr_score >= 0 THEN 0.25 * correlation_similarity + 0.15 * logic_consistency + 0.60 * (1.0 - tstr_gap)
        ELSE 0.5 * correlation_similarity + 0.5 * logic_consistency END, 6) AS composite_utility,
  round(0.5 * (1.0 - greatest(singling_out_risk, linkability_risk, cmla_risk)) + 0.5 * (CASE WHEN tstr_score >= 0
        THEN 0.25 * correlation_similarity + 0.15 * logic_consistency + 0.60 * (1.0 - tstr_gap)
        ELSE 0.5 * correlation_similarity + 0.5 * logic_consistency END), 6) AS composite_score FROM records"""))
def composite_scores(spark, d):
    c = au.composite_scores(records(spark, d))
    return c.select("model", rnd("privacy_score").alias("privacy_score"),
                    rnd("composite_utility").alias("composite_utility"), rnd("composite_score").alias("composite_score"))


_BEST = """(SELECT model FROM records WHERE model <> 'truncated'
   ORDER BY overall_pass DESC, composite_score DESC NULLS LAST, config_order LIMIT 1)"""


@query("rank_models", oracle(RECORDS_CTE + f"""SELECT
  CAST(row_number() OVER (ORDER BY composite_score DESC NULLS LAST, config_order) AS INTEGER) AS rank, model,
  singling_out_risk, linkability_risk, cmla_risk, correlation_similarity, logic_consistency, composite_score,
  overall_pass, model = {_BEST} AS is_recommended FROM records"""))
def rank_models(spark, d):
    return au.rank_models(records(spark, d))


@query("recommend_model", oracle(RECORDS_CTE + f"""SELECT {_BEST} AS recommended_model,
  (SELECT count(*) FROM records WHERE overall_pass) > 0 AS threshold_passed"""))
def recommend_model(spark, d):
    recs = records(spark, d)
    best = au.recommend(recs)
    passed = recs.where("overall_pass").count() > 0
    return spark.createDataFrame([(best, passed)], "recommended_model string, threshold_passed boolean")


@query("passing_models", oracle(RECORDS_CTE + "SELECT model, composite_score FROM records WHERE overall_pass"))
def passing_models(spark, d):
    return records(spark, d).where("overall_pass").select("model", "composite_score")


@query("tradeoff_points", oracle(RECORDS_CTE + """SELECT model,
  greatest(singling_out_risk, linkability_risk, cmla_risk) AS max_risk, composite_utility,
  greatest(singling_out_risk, linkability_risk, cmla_risk) > 0.1 AS above_risk_line FROM records"""))
def tradeoff_points(spark, d):
    return au.tradeoff_points(records(spark, d))


@query("winner_comparison", oracle(RECORDS_CTE + qu._corr_pairs_cte("f_train", "wr") + qu._corr_pairs_cte("f_syn", "ws_p")
       + qu._corr_pairs_cte("f_train", "ws_c") + f"""
, best AS (SELECT {_BEST} AS m)
SELECT (SELECT m FROM best) AS model, wr.col_a, wr.col_b, round(wr.corr, 6) AS corr_real,
  round(CASE WHEN (SELECT m FROM best) = 'copy' THEN ws_c.corr ELSE ws_p.corr END, 6) AS corr_syn
FROM wr JOIN ws_p USING (col_a, col_b) JOIN ws_c USING (col_a, col_b)"""))
def winner_comparison(spark, d):
    """V3: real and winning synthetic correlation matrices side by side."""
    from synthaudit.operators import stats

    train, syn, _ctl = fx.three_way(spark, d)
    best = au.recommend(records(spark, d))
    table = {"perturbed": syn, "copy": train}[best]
    c = stats.correlation_difference(train, table, key=fx.KEY)
    return c.select(F.lit(best).alias("model"), "col_a", "col_b", rnd("corr_real").alias("corr_real"),
                    rnd("corr_syn").alias("corr_syn"))


_RISK_ROWS = " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{a}' AS attack_name, CAST({p}_{t}.n AS BIGINT) AS n, CAST({p}_{t}.s AS BIGINT) AS s, "
    f"CAST({p}_{t}.c AS BIGINT) AS c, round({p}_{t}.risk, 6) AS risk_score, round({p}_{t}.lo, 6) AS ci_lower, "
    f"round({p}_{t}.hi, 6) AS ci_upper FROM {p}_{t}"
    for m, p in (("perturbed", "pz"), ("copy", "cp")) for a, t in (("SinglingOut", "sor"), ("Linkability", "lkr")))


@query("attack_risk", oracle(RECORDS_CTE + _RISK_ROWS))
def attack_risk(spark, d):
    r = au.attack_risk(records(spark, d))
    return r.select("model", "attack_name", "n", "s", "c", rnd("risk_score").alias("risk_score"),
                    rnd("ci_lower").alias("ci_lower"), rnd("ci_upper").alias("ci_upper"))


_CI = "CASE WHEN model = 'truncated' THEN 'N/A' ELSE printf('[%.3f, %.3f]', {p}_ci_lower, {p}_ci_upper) END"
_RANKED = "CAST(row_number() OVER (ORDER BY composite_score DESC NULLS LAST, config_order) AS INTEGER)"
REPORT_COLS = [c for c in REC_COLS if c != "config_order"]


@query("report_full", oracle(RECORDS_CTE + f"""SELECT {_RANKED} AS rank, {', '.join(REPORT_COLS)},
  {_CI.format(p='so')} AS singling_out_ci, {_CI.format(p='link')} AS linkability_ci, '{{}}' AS model_config,
  model = {_BEST} AS is_recommended FROM records"""))
def report_full(spark, d):
    """The exported report, every score and flag of every candidate."""
    r = au.full_report(records(spark, d))
    ci = ("so_ci_lower", "so_ci_upper", "link_ci_lower", "link_ci_upper")
    return r.select("rank", *[rnd(c).alias(c) if c in ci else F.col(c) for c in REPORT_COLS],
                    "singling_out_ci", "linkability_ci", "model_config", "is_recommended")


@query("summary_results", oracle(RECORDS_CTE + f"""SELECT {_RANKED} - 1 AS place, model, composite_score, overall_pass,
  model = {_BEST} AS is_recommended, {_BEST} AS recommended_model,
  (SELECT count(*) FROM records WHERE overall_pass) > 0 AS threshold_passed FROM records"""))
def summary_results(spark, d):
    """The results of the summary document, in its order."""
    s = au.summary(records(spark, d), AuditConfig(), 0.0)
    rows = s.select(F.posexplode("results").alias("place", "r"), "recommended_model", "threshold_passed")
    return rows.select("place", "r.model", "r.composite_score", "r.overall_pass", "r.is_recommended",
                       "recommended_model", "threshold_passed")


@query("audit_isolation", oracle(RECORDS_CTE + "SELECT * FROM records WHERE model = 'perturbed' UNION ALL "
                                 + FAILED_SELECT.replace("'truncated'", "'broken'").replace("2 AS config_order",
                                                                                          "1 AS config_order")))
def audit_isolation(spark, d):
    """A candidate whose rows cannot be computed costs its own record only."""
    train, syn, ctl = fx.three_way(spark, d)
    broken = syn.withColumn("sum_qty", F.raise_error(F.lit("unreadable block")).cast("double"))
    cands = [au.Candidate("perturbed", syn), au.Candidate("broken", broken)]
    return _rec_out(au.audit(train, ctl, cands, fx.KEY, AuditConfig(), cluster_labels="o_orderstatus"))
