"""Queries: synthesizers and the end-to-end audit."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from synthaudit.config import AuditConfig
from synthaudit.operators import logic, stats
from synthaudit.operators.synth import build
from synthaudit.operators.synth.base import NotAvailable
from synthaudit.operators.synth.dptree import column_codes, marginal_counts
from synthaudit.plans import audit as au
from synthaudit.plans import fixtures as fx
from synthaudit.plans.catalog import oracle, query, rnd

NUMS = ["o_totalprice", "c_acctbal", "n_lines", "sum_qty", "sum_price"]
CATS = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
# Declared bounds of the fixture columns for the DP model (public knowledge
# of the schema, not read from the data).
BOUNDS = {"o_totalprice": (0.0, 500000.0), "c_acctbal": (-1000.0, 10000.0), "n_lines": (0.0, 20.0),
          "sum_qty": (0.0, 500.0), "sum_price": (0.0, 1200000.0)}
BINS = 20


@query("copula_marginals", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, CAST(count(*) AS BIGINT) AS n FROM f_train GROUP BY {c}"
    for c in CATS)))
def copula_marginals(spark, d):
    train, _syn, _ctl = fx.three_way(spark, d)
    m = build("copula").fit(train, fx.KEY)
    rows = []
    for c in m.cats:
        t = m.cat_tables[c]
        rows += [(c, v, int(k)) for v, k in zip(t["values"], t["counts"])]
    return spark.createDataFrame(rows, "column_name string, value string, n bigint")


KNOTS_CTE = """, x AS (SELECT column_name, list_sort(list(v)) AS v FROM (
  SELECT unnest([%s]) AS column_name, unnest([%s]) AS v FROM f_train) WHERE v IS NOT NULL GROUP BY column_name),
k AS (SELECT *, greatest(2, least(1001, len(v) // 2 + 1)) AS n_knots FROM x)
SELECT column_name, CAST(i AS INTEGER) AS knot, v[greatest(1, CAST(ceil((i / (n_knots - 1.0)::DOUBLE) * len(v)) AS BIGINT))] AS value
FROM (SELECT *, unnest(range(0, n_knots)) AS i FROM k)""" % (
    ", ".join(f"'{c}'" for c in NUMS), ", ".join(f"CAST({c} AS DOUBLE)" for c in NUMS))


@query("copula_knots", oracle(KNOTS_CTE))
def copula_knots(spark, d):
    """The fitted quantile knots of every numeric column."""
    train, _syn, _ctl = fx.three_way(spark, d)
    m = build("copula").fit(train, fx.KEY)
    rows = [(c, i, float(v)) for c in m.nums for i, v in enumerate(m.knots[c])]
    return spark.createDataFrame(rows, "column_name string, knot int, value double")


def _synth_report(spark, train, syn, name, model):
    prof = stats.ColumnProfile.of(train, fx.KEY)
    sim = stats.correlation_similarity(train, syn, fx.KEY).first()[0]
    lg = logic.logic_score(logic.logic_check(train, syn, fx.KEY, prof)).first()
    syn.unpersist()
    return spark.createDataFrame(
        [(name, int(lg["n_rows"]), float(sim), float(lg["logic_consistency"]), int(lg["n_violations"]),
          float(model.fit_seconds), float(model.sample_seconds))],
        "model string, n_rows bigint, correlation_similarity double, logic_consistency double, "
        "n_violations bigint, fit_seconds double, sample_seconds double")


@query("synth_copula")
def synth_copula(spark, d):
    train, _syn, _ctl = fx.three_way(spark, d)
    m = build("copula").fit(train, fx.KEY)
    return _synth_report(spark, train, m.sample(train.count(), seed=42).persist(), "copula", m)


@query("synth_dptree")
def synth_dptree(spark, d):
    train, _syn, _ctl = fx.three_way(spark, d)
    m = build("privbayes", bounds=BOUNDS, bins=BINS).fit(train, fx.KEY)
    return _synth_report(spark, train, m.sample(train.count(), seed=42).persist(), "privbayes", m)


def _code_sql(c: str) -> str:
    if c in NUMS:
        lo, hi = BOUNDS[c]
        w = (hi - lo) / BINS
        return (f"CAST(CASE WHEN {c} IS NULL THEN {BINS} ELSE least({BINS - 1}, greatest(0, "
                f"CAST(floor(({c} - {lo!r}) / {w!r}) AS INTEGER))) END AS VARCHAR)")
    return f"coalesce(CAST({c} AS VARCHAR), chr(0))"


_COLS = NUMS + CATS
_CODES_CTE = ", codes AS (SELECT " + ", ".join(f"{_code_sql(c)} AS {c}" for c in _COLS) + " FROM f_train)"
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]
_M2_CTE = ", m2 AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {a} AS va, {b} AS vb, CAST(count(*) AS BIGINT) AS n FROM codes GROUP BY {a}, {b}"
    for a, b in _PAIRS) + ")"


@query("pairwise_marginals", oracle(_CODES_CTE + _M2_CTE + " SELECT * FROM m2"))
def pairwise_marginals(spark, d):
    train, _syn, _ctl = fx.three_way(spark, d)
    codes = column_codes(train, NUMS, CATS, BOUNDS, BINS)
    return marginal_counts(codes, _COLS).where(F.col("col_b") != "")


_MI_CTE = """
, tot AS (SELECT col_a, col_b, sum(n) AS t FROM m2 GROUP BY col_a, col_b)
, pa AS (SELECT col_a, col_b, va, sum(n) AS na FROM m2 GROUP BY col_a, col_b, va)
, pb AS (SELECT col_a, col_b, vb, sum(n) AS nb FROM m2 GROUP BY col_a, col_b, vb)
, mi AS (SELECT m2.col_a, m2.col_b, sum((m2.n / tot.t) * ln((m2.n / tot.t) / ((pa.na / tot.t) * (pb.nb / tot.t)))) AS mi
FROM m2 JOIN tot USING (col_a, col_b) JOIN pa USING (col_a, col_b, va) JOIN pb USING (col_a, col_b, vb)
GROUP BY m2.col_a, m2.col_b)"""


@query("mutual_information", oracle(_CODES_CTE + _M2_CTE + _MI_CTE + " SELECT col_a, col_b, round(mi, 6) AS mi FROM mi"))
def mutual_information_q(spark, d):
    """MI of every pair from exact counts (the noise-free case of the fit)."""
    train, _syn, _ctl = fx.three_way(spark, d)
    codes = column_codes(train, NUMS, CATS, BOUNDS, BINS)
    m = marginal_counts(codes, _COLS).where(F.col("col_b") != "")
    tot = m.groupBy("col_a", "col_b").agg(F.sum("n").alias("t"))
    pa = m.groupBy("col_a", "col_b", "va").agg(F.sum("n").alias("na"))
    pb = m.groupBy("col_a", "col_b", "vb").agg(F.sum("n").alias("nb"))
    j = m.join(tot, ["col_a", "col_b"]).join(pa, ["col_a", "col_b", "va"]).join(pb, ["col_a", "col_b", "vb"])
    p = F.col("n") / F.col("t")
    term = p * F.log(p / ((F.col("na") / F.col("t")) * (F.col("nb") / F.col("t"))))
    return j.groupBy("col_a", "col_b").agg(rnd(F.sum(term)).alias("mi"))


_FIT_SQL = " UNION ALL ".join(
    [f"SELECT 'count' AS part, '{c}' AS col_a, '' AS col_b, {c} AS code, CAST(count(*) AS DOUBLE) AS value FROM codes GROUP BY {c}"
     for c in _COLS]
    + ["SELECT 'mi', col_a, col_b, '', round(mi, 6) FROM mi"])


@query("dptree_fit", oracle(_CODES_CTE + _M2_CTE + _MI_CTE + _FIT_SQL))
def dptree_fit(spark, d):
    """What the tree model fits when its noise is practically off."""
    train, _syn, _ctl = fx.three_way(spark, d)
    m = build("privbayes", epsilon=1e12, bounds=BOUNDS, bins=BINS).fit(train, fx.KEY)
    counts = m.counts().select(F.lit("count").alias("part"), "col_a", F.lit("").alias("col_b"), "code",
                               F.round("n").alias("value")).where("value > 0")
    rows = [("mi", a, b, "", round(v, 6)) for (a, b), v in m.mi.items()]
    return counts.unionByName(spark.createDataFrame(rows, "part string, col_a string, col_b string, code string, value double"))


RELEASED_FROM = 40


@query("dptree_domains", fx.ORACLE_FIXTURES + f"""
, w AS (SELECT CASE WHEN row_key % 13 = 0 THEN NULL ELSE 'w' || CAST(CAST(floor(sqrt(row_key % 6007)) AS BIGINT) AS VARCHAR) END AS word FROM facts)
, n AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT CASE WHEN word IS NULL THEN '(null)' WHEN n >= {RELEASED_FROM} THEN word ELSE '(other)' END AS code,
       CAST(sum(n) AS DOUBLE) AS n FROM n GROUP BY 1""")
def dptree_domains(spark, d):
    """Values that enough rows share are released, the others are one code
    (noise practically off, so the threshold is the declared one)."""
    word = F.when(F.col(fx.KEY) % 13 != 0, F.concat(F.lit("w"), F.floor(F.sqrt(F.col(fx.KEY) % 6007)).cast("string")))
    real = fx.facts(spark, d).select(fx.KEY, word.alias("word"), "n_lines")
    m = build("privbayes", epsilon=1e12, delta=1e-6, min_count=RELEASED_FROM - 0.5, bounds={"n_lines": (0.0, 20.0)}).fit(real, fx.KEY)
    counts = m.counts().where("col_a = 'word'").select(
        F.when(F.col("code") == "\u0000", "(null)").otherwise(F.col("code")).alias("code"), F.round("n").alias("n"))
    return counts.where("n > 0")


def end_to_end(spark, d, cfg: AuditConfig | None = None):
    """O1: split → fit every configured generator on train → sample as many
    rows → audit every candidate → records (failed generators get a row)."""
    cfg = cfg or AuditConfig(models={"copula": {}, "privbayes": {"bounds": BOUNDS}, "ctgan": {"epochs": 300}})
    t0 = time.perf_counter()
    if cfg.max_rows:
        # The original tool's optional row cap, then the same split
        from synthaudit.operators.sampling import sample_n, train_control_split

        capped = sample_n(fx.cached_facts(spark, d), fx.KEY, cfg.max_rows, cfg.random_seed)
        train, control = train_control_split(capped, fx.KEY, cfg.train_ratio, cfg.random_seed)
    else:
        train, control = fx.split(spark, d, cfg.train_ratio, cfg.random_seed)
    real = au.RealSide(train, control, fx.KEY, cfg).start()
    tables = {}

    # generators are fitted, sampled and audited while the real side is computed
    makers = {name: (lambda name=name, kw=kw: au.make_candidate(name, kw, real, cfg.random_seed, tables)) for name, kw in cfg.models.items()}
    recs = au.audit_generators(real, makers).cache()
    recs.count()
    for t in tables.values():
        t.unpersist()
    real.release()
    return recs, time.perf_counter() - t0, cfg


@query("audit_end_to_end")
def audit_end_to_end(spark, d):
    recs, _t, _cfg = end_to_end(spark, d)
    return au.rank_models(recs)


# The original tool's saved run: cap 2,000 rows, five generators requested.
REFERENCE_RUN = AuditConfig(max_rows=2000, models={
    "copula": {}, "ctgan": {"epochs": 300, "batch_size": 500}, "tvae": {"epochs": 300, "batch_size": 500},
    "privbayes": {"epsilon": 1.0, "bounds": BOUNDS}, "pategan": {"epsilon": 1.0}})


@query("audit_reference_run")
def audit_reference_run(spark, d):
    """O1 with the original tool's run configuration (row cap is the feature)."""
    recs, _t, _cfg = end_to_end(spark, d, REFERENCE_RUN)
    return au.rank_models(recs)


@query("summary_json")
def summary_json(spark, d):
    recs, t, cfg = end_to_end(spark, d)
    return au.summary(recs, cfg, t).select(F.to_json(F.struct("*")).alias("json"))


@query("synth_dptree_wide", fx.ORACLE_FIXTURES + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_unknown,
       count(DISTINCT row_key % 1499) > 1000 AS is_wide
FROM facts""")
def synth_dptree_wide(spark, d):
    """A text column with far more values than the model has codes: no sampled
    value may be null or unknown to the real table."""
    from synthaudit.operators.synth import build

    real = fx.facts(spark, d).select(
        fx.KEY, "sum_qty", F.concat(F.lit("v-"), F.pmod(fx.KEY, F.lit(1499))).alias("many-values"))
    model = build("dptree", epsilon=1.0, bounds={"sum_qty": (0.0, 500.0)}).fit(real, fx.KEY)
    known = real.select(F.col("many-values").alias("known")).distinct()
    syn = model.sample(real.count(), seed=42)
    return syn.join(known, syn["many-values"] == known["known"], "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("many-values").isNull()).alias("n_null"),
        F.count_if(F.col("many-values").isNotNull() & F.col("known").isNull()).alias("n_unknown"),
        (F.lit(known.count()) > 1000).alias("is_wide"))
