"""Queries: correlation, bounds, logic and utility."""

from __future__ import annotations


from synthaudit.operators import logic, stats
from synthaudit.operators.utility import utility_report
from synthaudit.plans import fixtures as fx
from synthaudit.plans.catalog import oracle, query, rnd

NUMS = ["o_totalprice", "c_acctbal", "n_lines", "sum_qty", "sum_price"]
PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1:]]


def _corr_sql(table: str) -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM {table}"
             for a, b in PAIRS]
    return "\nUNION ALL ".join(parts)


def _corr_pairs_cte(table: str, name: str) -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM {table}"
             for a, b in PAIRS]
    return f", {name} AS (" + " UNION ALL ".join(parts) + ")"


SIM_CTE = (_corr_pairs_cte("f_train", "cr") + _corr_pairs_cte("f_syn", "cs") + """
, sim AS (SELECT CASE WHEN count(*) FILTER (WHERE d IS NULL) > 0 THEN NULL
                      ELSE 1.0 - 2.0 * sum(d) / 20.0 END AS correlation_similarity
          FROM (SELECT abs(cr.corr - cs.corr) AS d FROM cr JOIN cs USING (col_a, col_b)))
""")


@query("correlation_matrix", oracle(_corr_sql("f_train")))
def correlation_matrix(spark, d):
    train, _syn, _ctl = fx.three_way(spark, d)
    m = stats.correlation_matrix(train, key=fx.KEY)
    return m.select("col_a", "col_b", rnd("corr").alias("corr"))


@query("correlation_similarity", oracle(SIM_CTE + "SELECT round(correlation_similarity, 6) AS correlation_similarity FROM sim"))
def correlation_similarity(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    s = stats.correlation_similarity(train, syn, key=fx.KEY)
    return s.select(rnd("correlation_similarity").alias("correlation_similarity"))


@query("corr_diff", oracle(_corr_pairs_cte("f_train", "cr") + _corr_pairs_cte("f_syn", "cs") + """
SELECT col_a, col_b, round(cr.corr, 6) AS corr_real, round(cs.corr, 6) AS corr_syn,
       round(cr.corr - cs.corr, 6) AS corr_diff FROM cr JOIN cs USING (col_a, col_b)"""))
def corr_diff(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    c = stats.correlation_difference(train, syn, key=fx.KEY)
    return c.select("col_a", "col_b", rnd("corr_real").alias("corr_real"),
                    rnd("corr_syn").alias("corr_syn"), rnd("corr_diff").alias("corr_diff"))


def _bounds_sql(table: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM {table}"
        for c in NUMS)


@query("column_bounds", oracle(_bounds_sql("f_train")))
def column_bounds(spark, d):
    train, _syn, _ctl = fx.three_way(spark, d)
    return stats.column_bounds(train, key=fx.KEY)


_LOGIC_CTE = ", b AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, min({c}) AS lo, max({c}) AS hi FROM f_train" for c in NUMS) + ")" + """
, bv AS (SELECT b.column, b.column || '_boundary' AS violation_key,
        CAST(CASE b.column """ + " ".join(
    f"WHEN '{c}' THEN (SELECT count(*) FROM f_syn WHERE {c} < b.lo OR {c} > b.hi)" for c in NUMS) + """ END AS BIGINT) AS n_violations
        FROM b)
, nv AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{c}_unexpected_nulls' AS violation_key, "
    f"CAST((SELECT count(*) FROM f_syn WHERE {c} IS NULL) AS BIGINT) AS n_violations "
    f"WHERE (SELECT count(*) FROM f_train WHERE {c} IS NULL) = 0"
    for c in fx.FACT_COLUMNS[1:]) + ")"


@query("boundary_violations", oracle(_LOGIC_CTE + "SELECT * FROM bv WHERE n_violations > 0"))
def boundary_violations(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    agg = logic.logic_check(train, syn, key=fx.KEY)
    return logic.violations(agg, "boundary")


@query("null_invariance", oracle(_LOGIC_CTE + "SELECT * FROM nv WHERE n_violations > 0"))
def null_invariance(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    agg = logic.logic_check(train, syn, key=fx.KEY)
    return logic.violations(agg, "unexpected_nulls")


LOGIC_SCORE_CTE = _LOGIC_CTE + """
, lg AS (SELECT CAST((SELECT count(*) FROM f_syn) AS BIGINT) AS n_rows,
        CAST((SELECT count(*) FROM f_syn) * ((SELECT count(*) FROM bv) + (SELECT count(*) FROM nv)) AS BIGINT) AS n_cells,
        CAST((SELECT sum(n_violations) FROM bv) + (SELECT sum(n_violations) FROM nv) AS BIGINT) AS n_violations)
, lgs AS (SELECT *, CASE WHEN n_cells = 0 THEN 1.0
                    ELSE greatest(0.0, 1.0 - n_violations / n_cells) END AS logic_consistency FROM lg)
"""


@query("logic_consistency", oracle(LOGIC_SCORE_CTE +
       "SELECT n_rows, n_cells, n_violations, round(logic_consistency, 6) AS logic_consistency FROM lgs"))
def logic_consistency(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    s = logic.logic_score(logic.logic_check(train, syn, key=fx.KEY))
    return s.select("n_rows", "n_cells", "n_violations", rnd("logic_consistency").alias("logic_consistency"))


@query("utility_report", oracle(SIM_CTE + LOGIC_SCORE_CTE + """
SELECT round(sim.correlation_similarity, 6) AS correlation_similarity,
       round(lgs.logic_consistency, 6) AS logic_consistency,
       CAST(-1.0 AS DOUBLE) AS tstr_score, CAST(-1.0 AS DOUBLE) AS tstr_baseline, CAST(-1.0 AS DOUBLE) AS tstr_gap,
       round(0.5 * sim.correlation_similarity + 0.5 * lgs.logic_consistency, 6) AS composite_utility
FROM sim, lgs"""))
def utility_report_q(spark, d):
    train, syn, _ctl = fx.three_way(spark, d)
    u = utility_report(train, syn, key=fx.KEY)
    return u.select(rnd("correlation_similarity").alias("correlation_similarity"),
                    rnd("logic_consistency").alias("logic_consistency"),
                    "tstr_score", "tstr_baseline", "tstr_gap",
                    rnd("composite_utility").alias("composite_utility"))
