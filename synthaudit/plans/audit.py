"""The audit: score candidate synthetic tables against real data.

``audit(train, control, candidates, key, cfg)`` runs, for every candidate,
the three attacks and the utility bundle, derives flags and scores and
returns one record per candidate (failed candidates get the fail-safe
placeholder).  All real-side work — column profile, correlation matrix,
k-means, medoids, calibration threshold, attack target samples — is done
once and shared.  The loop over candidates runs on the driver; every step
inside it is a Spark job over whole tables, and only scalars come back.
"""

from __future__ import annotations

import json
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from synthaudit.config import AuditConfig, UTILITY_SHARES
from synthaudit.functions.columns import feature_columns
from synthaudit.functions.parallel import PARALLEL_JOBS, run_parallel  # noqa: F401 (re-exported)
from synthaudit.operators.synth import build
from synthaudit.operators import cmla as cm
from synthaudit.operators import linkability as lk
from synthaudit.operators import singling_out as so
from synthaudit.operators import stats
from synthaudit.operators.results import failed_result
from synthaudit.operators.utility import UtilityResult, evaluate

RECORD_SCHEMA = (
    "model string, singling_out_risk double, singling_out_ci string, linkability_risk double, "
    "linkability_ci string, cmla_risk double, correlation_similarity double, logic_consistency double, "
    "tstr_score double, tstr_baseline double, tstr_gap double, composite_utility double, "
    "privacy_score double, composite_score double, privacy_pass boolean, utility_pass boolean, "
    "overall_pass boolean, model_config string, violation_breakdown string, cmla_notes string, "
    "notes string, config_order int, so_ci_lower double, so_ci_upper double, "
    "link_ci_lower double, link_ci_upper double, so_n bigint, so_s bigint, so_c bigint, "
    "lk_n bigint, lk_s bigint, lk_c bigint")
RECORD_FIELDS = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]


@dataclass
class Candidate:
    """A synthetic table to audit, or the reason it could not be made."""
    name: str
    syn: DataFrame | None = None
    config: dict = field(default_factory=dict)
    error: str | None = None


class RealSide:
    """Real-side statistics shared by all candidates of one audit."""

    def __init__(self, train: DataFrame, control: DataFrame, key: str, cfg: AuditConfig,
                 cluster_labels: str | None = None):
        # persisted once: every attack and metric of every candidate reads them
        self.train, self.control = train.persist(), control.persist()
        self.key, self.cfg = key, cfg
        self.cols = feature_columns(train, key)
        self.profile = stats.ColumnProfile.of(self.train, key)
        self.corr_cols = stats.shared_numeric_columns(train, train, key)
        self.corr = stats.correlation_matrix(
            self.train, cols=self.corr_cols, means={c: self.profile.mean[c] for c in self.corr_cols}).cache()
        self.n_train = self.profile.n_rows
        self.n_control = self.control.count()
        self.half_a, self.half_b = lk.halves(self.cols)
        self.cluster_labels = cluster_labels
        self._futures: dict = {}
        self._pool = None
        self._lock = threading.Lock()

    def _compute_targets(self):
        n = self.cfg.n_attacks
        return (lk.target_rows(self.train, self.key, self.cols, n, self.cfg.random_seed, self.n_train),
                lk.target_rows(self.control, self.key, self.cols, n, self.cfg.random_seed, self.n_control))

    def _compute_cmla(self):
        c = self.cfg
        return cm.fit_reference(self.train, self.key, c.n_clusters, c.distance_percentile,
                                self.cluster_labels, c.calibration, 500, c.random_seed, c.kmeans_max_iter, c.kmeans_tol)

    def start(self) -> "RealSide":
        """Start the shared parts (attack targets, CMLA reference) in the
        background; candidates block only when they need them."""
        with self._lock:
            if not self._futures:
                self._pool = ThreadPoolExecutor(max_workers=2)
                self._futures = {"targets": self._pool.submit(self._compute_targets),
                                 "cmla": self._pool.submit(self._compute_cmla)}
        return self

    def prepare(self):
        """Compute the shared parts now."""
        self.start()
        for f in self._futures.values():
            try:
                f.result()
            except ValueError:
                pass

    def release(self) -> None:
        """Unpersist what this audit cached (after its results are collected)."""
        for f in self._futures.values():
            try:
                f.result()
            except Exception:  # noqa: BLE001 - nothing to release for a failed part
                pass
        ref = self._futures.get("cmla")
        if ref is not None and ref.exception() is None:
            for df in ref.result().cached:
                df.unpersist()
        if self._pool is not None:
            self._pool.shutdown(wait=False)
        self.corr.unpersist()
        self.train.unpersist()
        self.control.unpersist()

    def targets(self, n: int | None = None):
        return self.start()._futures["targets"].result()

    def cmla_reference(self):
        return self.start()._futures["cmla"].result()


def _ci(lo, hi) -> str:
    return f"[{lo:.3f}, {hi:.3f}]"


def _r4(x):
    return None if x is None else round(float(x), 4)


def failed_record(name: str, reason: str, config: dict | None = None, order: int = 0) -> dict:
    """U4: placeholder of a candidate that could not be audited."""
    return {"model": name, "singling_out_risk": 1.0, "singling_out_ci": "N/A", "linkability_risk": 1.0,
            "linkability_ci": "N/A", "cmla_risk": 1.0, "correlation_similarity": 0.0,
            "logic_consistency": 0.0, "tstr_score": -1.0, "tstr_baseline": -1.0, "tstr_gap": -1.0,
            "composite_utility": 0.0, "privacy_score": 0.0, "composite_score": 0.0,
            "privacy_pass": False, "utility_pass": False, "overall_pass": False,
            "model_config": json.dumps(config or {}), "violation_breakdown": "{}", "cmla_notes": None,
            "notes": reason, "config_order": order, "so_ci_lower": 1.0, "so_ci_upper": 1.0,
            "link_ci_lower": 1.0, "link_ci_upper": 1.0}


def audit_pair(real: RealSide, syn: DataFrame, name: str = "given", model_config: dict | None = None,
               order: int = 0) -> dict:
    """O2/O3: audit record of one synthetic table."""
    cfg, key = real.cfg, real.key
    missing = [c for c in real.cols if c not in syn.columns]
    if missing:
        return failed_record(name, f"synthetic table lacks columns {missing}", model_config, order)
    n_syn = syn.count()
    n_att = min(cfg.n_attacks, real.n_train, real.n_control, n_syn)      # T9
    pt, ut, w = cfg.privacy_thresholds, cfg.utility_thresholds, cfg.score_weights
    tr, tc = real.targets(cfg.n_attacks)

    no_table = []                   # the error of a utility part that could not read the table

    def kept(name, measure, otherwise=failed_result):
        try:
            return measure()
        except Exception as exc:  # noqa: BLE001 - the other measurements keep their results
            return otherwise(name, exc)

    def no_utility(_name, exc):
        no_table.append(exc)
        return UtilityResult(None, 0.0, notes=f"utility failed: {(str(exc).splitlines() or [''])[0]}")

    res = run_parallel({
        "so": lambda: kept("SinglingOut", lambda: so.singling_out(real.train, syn, real.control, key, n_att,
                                                                  cfg.random_seed)),
        "lk": lambda: kept("Linkability", lambda: lk.link_risk(tr.head(n_att), tc.head(n_att), syn, key, real.half_a,
                                                               real.half_b)),
        "cm": lambda: kept("CMLA", lambda: cm.score(real.cmla_reference(), syn, key)),
        "u": lambda: kept("utility", lambda: evaluate(real.train, syn, key, cfg.target_col, profile=real.profile,
                                                      real_corr=real.corr), no_utility),
    })
    if no_table and not any(r.n_attacks_run for r in res.values() if r is not res["u"]):
        raise no_table[0]                       # nothing about this table could be measured
    so_r, lk_r, cm_r, u = res["so"], res["lk"], res["cm"], res["u"]
    so_r.with_threshold(pt["singling_out"])
    lk_r.with_threshold(pt["linkability"])
    cm_r.with_threshold(pt["cmla"])
    # Inclusive comparisons; an undefined similarity fails
    privacy_pass = so_r.passed_threshold and lk_r.passed_threshold and cm_r.passed_threshold
    utility_pass = (u.logic_consistency >= ut["logic_consistency"]
                    and u.correlation_similarity is not None
                    and u.correlation_similarity >= ut["correlation_similarity"])
    if cfg.target_col and u.tstr_gap >= 0:
        utility_pass = utility_pass and u.tstr_gap <= ut["tstr_gap_max"]
    privacy_score = 1.0 - max(so_r.risk_score, lk_r.risk_score, cm_r.risk_score)   # G14
    cu = u.composite_utility
    composite = None if cu is None else w["privacy"] * privacy_score + w["utility"] * cu  # G16
    return {
        "model": name, "singling_out_risk": _r4(so_r.risk_score),
        "singling_out_ci": _ci(so_r.ci_lower, so_r.ci_upper), "linkability_risk": _r4(lk_r.risk_score),
        "linkability_ci": _ci(lk_r.ci_lower, lk_r.ci_upper), "cmla_risk": _r4(cm_r.risk_score),
        "correlation_similarity": _r4(u.correlation_similarity), "logic_consistency": _r4(u.logic_consistency),
        "tstr_score": _r4(u.tstr_score), "tstr_baseline": _r4(u.tstr_baseline), "tstr_gap": _r4(u.tstr_gap),
        "composite_utility": _r4(cu), "privacy_score": _r4(privacy_score), "composite_score": _r4(composite),
        "privacy_pass": bool(privacy_pass), "utility_pass": bool(utility_pass),
        "overall_pass": bool(privacy_pass and utility_pass),
        "model_config": json.dumps(model_config or {}),
        "violation_breakdown": json.dumps(u.column_violation_breakdown),
        "cmla_notes": cm_r.notes, "notes": " ; ".join(n for n in (so_r.notes, lk_r.notes, u.notes) if n), "config_order": order,
        "so_ci_lower": so_r.ci_lower, "so_ci_upper": so_r.ci_upper,
        "link_ci_lower": lk_r.ci_lower, "link_ci_upper": lk_r.ci_upper,
        "so_n": so_r.n_attacks_run, "so_s": so_r.n_success, "so_c": so_r.n_control_success,
        "lk_n": lk_r.n_attacks_run, "lk_s": lk_r.n_success, "lk_c": lk_r.n_control_success,
    }


def isolated_pair(real: RealSide, syn: DataFrame, name: str, config: dict | None = None, order: int = 0) -> dict:
    """The record of :func:`audit_pair`, or a failed record if it cannot be made."""
    try:
        return audit_pair(real, syn, name, config, order)
    except Exception as exc:  # noqa: BLE001 - per-model isolation, as the original tool
        return failed_record(name, f"Evaluation failed: {exc}", config, order)


def audit_generators(real: RealSide, makers: dict) -> DataFrame:
    """O1 pipelined: every generator is fitted, sampled and audited in its
    own driver thread while the shared real-side parts are computed; a
    candidate waits for them only at the step that needs them."""
    real.start()

    def one(i, name, make):
        try:
            c = make()
        except Exception as exc:  # noqa: BLE001 - a broken maker costs its own record only
            return failed_record(name, f"Generator failed: {exc}", {}, i)
        if c.error is not None or c.syn is None:
            return failed_record(c.name, c.error or "no synthetic table", c.config, i)
        return isolated_pair(real, c.syn, c.name, c.config, i)

    tasks = {i: (lambda i=i, name=name, make=make: one(i, name, make)) for i, (name, make) in enumerate(makers.items())}
    out = run_parallel(tasks)   # records are plain values now; callers may release the inputs
    return records_frame(real.train.sparkSession, [out[i] for i in range(len(makers))])


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """The per-model records as one DataFrame (missing fields NULL)."""
    rows = [tuple(r.get(f) for f in RECORD_FIELDS) for r in records]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def audit(train: DataFrame, control: DataFrame, candidates: list[Candidate], key: str,
          cfg: AuditConfig | None = None, cluster_labels: str | None = None,
          real_side: "RealSide | None" = None) -> DataFrame:
    """O1: one record per candidate; failures isolated per candidate."""
    cfg = cfg or AuditConfig()
    real = real_side if real_side is not None else RealSide(train, control, key, cfg, cluster_labels)
    real.start()

    def one(i, c):
        if c.error is not None or c.syn is None:
            return failed_record(c.name, c.error or "no synthetic table", c.config, i)
        return isolated_pair(real, c.syn, c.name, c.config, i)

    out = run_parallel({i: (lambda i=i, c=c: one(i, c)) for i, c in enumerate(candidates)}, 2)
    if real_side is None:
        real.release()
    return records_frame(train.sparkSession, [out[i] for i in range(len(candidates))])


# ----------------------------------------------------------------- ranking
def threshold_flags(records: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """R16 as column expressions over records (recomputes the three flags)."""
    cfg = cfg or AuditConfig()
    pt, ut = cfg.privacy_thresholds, cfg.utility_thresholds
    priv = ((F.col("singling_out_risk") <= pt["singling_out"]) & (F.col("linkability_risk") <= pt["linkability"])
            & (F.col("cmla_risk") <= pt["cmla"]))
    util = ((F.col("logic_consistency") >= ut["logic_consistency"])
            & (F.col("correlation_similarity") >= ut["correlation_similarity"]))
    if cfg.target_col:
        util = util & ((F.col("tstr_gap") < 0) | (F.col("tstr_gap") <= ut["tstr_gap_max"]))
    priv, util = F.coalesce(priv, F.lit(False)), F.coalesce(util, F.lit(False))
    return records.select("model", priv.alias("privacy_pass"), util.alias("utility_pass"),
                          (priv & util).alias("overall_pass"))


def composite_scores(records: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """G14–G16 as column expressions over records."""
    cfg = cfg or AuditConfig()
    w = cfg.score_weights
    priv = 1.0 - F.greatest("singling_out_risk", "linkability_risk", "cmla_risk")
    (c, g, t), (c0, g0) = UTILITY_SHARES["with_tstr"], UTILITY_SHARES["without"]
    cu = F.when(F.col("tstr_score") >= 0, c * F.col("correlation_similarity") + g * F.col("logic_consistency")
                + t * (1.0 - F.col("tstr_gap"))).otherwise(
        c0 * F.col("correlation_similarity") + g0 * F.col("logic_consistency"))
    return records.select("model", priv.alias("privacy_score"), cu.alias("composite_utility"),
                          (w["privacy"] * priv + w["utility"] * cu).alias("composite_score"))


def make_candidate(name: str, conf: dict, real: RealSide, seed: int, tables: dict) -> Candidate:
    """Fit the named generator on the training rows and sample as many; any
    error becomes the candidate's own.  The sample is cached and noted in ``tables``."""
    shown, step = {k: v for k, v in conf.items() if k != "bounds"}, "Training"
    try:
        model = build(name, **conf).fit(real.train, real.key)
        step = "Sampling"
        syn = tables[name] = model.sample(real.n_train, seed=seed).persist()
        syn.count()
    except Exception as exc:  # noqa: BLE001 - per-model isolation
        return Candidate(name, None, shown, f"{step} failed: {exc}")
    return Candidate(name, syn, shown)


def full_report(records: DataFrame) -> DataFrame:
    """Every field of every record, ranked, with the recommended row flagged."""
    narrow = rank_models(records).select("rank", F.col("model").alias("__m"), "is_recommended")
    return (records.join(narrow, records["model"] == narrow["__m"]).drop("__m", "config_order")
            .select("rank", *[c for c in records.columns if c != "config_order"], "is_recommended").orderBy("rank"))


def rank_models(records: DataFrame) -> DataFrame:
    """Narrow report ordered by composite score (NULL last), with
    the recommended row flagged.  Records are one per model (small)."""
    w = Window.orderBy(F.desc_nulls_last("composite_score"), F.asc("config_order"))
    best = recommend(records)
    return records.select(
        F.row_number().over(w).alias("rank"), "model", "singling_out_risk", "linkability_risk", "cmla_risk",
        "correlation_similarity", "logic_consistency", "composite_score", "overall_pass",
        (F.col("model") == F.lit(best)).alias("is_recommended") if best is not None
        else F.lit(False).alias("is_recommended"))


def recommend(records: DataFrame) -> str | None:
    """Best passing model, else best overall; NULL if every model
    failed to be audited (decision D14)."""
    r = (records.where(F.col("singling_out_ci") != "N/A")
         .orderBy(F.desc("overall_pass"), F.desc_nulls_last("composite_score"), F.asc("config_order"))
         .select("model", "composite_score", "correlation_similarity").first())
    if r is None:
        return None
    return r["model"]


def attack_risk(records: DataFrame) -> DataFrame:
    """G13 as column expressions: residual risk and Wilson interval of every
    (model, attack) from the stored success counts."""
    from synthaudit.functions.risk import residual_risk_cols

    rows = records.where(F.col("so_n").isNotNull()).select(
        "model", F.explode(F.array(
            F.struct(F.lit("SinglingOut").alias("attack_name"), F.col("so_n").alias("n"),
                     F.col("so_s").alias("s"), F.col("so_c").alias("c")),
            F.struct(F.lit("Linkability").alias("attack_name"), F.col("lk_n").alias("n"),
                     F.col("lk_s").alias("s"), F.col("lk_c").alias("c")))).alias("a")).select("model", "a.*")
    r, lo, hi = residual_risk_cols(F.col("s"), F.col("c"), F.col("n"))
    return rows.select("model", "attack_name", "n", "s", "c", r.alias("risk_score"), lo.alias("ci_lower"),
                       hi.alias("ci_upper"))


def tradeoff_points(records: DataFrame, risk_line: float = 0.1) -> DataFrame:
    """V2: privacy/utility trade-off data with the risk line."""
    max_risk = F.greatest("singling_out_risk", "linkability_risk", "cmla_risk")
    return records.select("model", max_risk.alias("max_risk"), "composite_utility",
                          (max_risk > risk_line).alias("above_risk_line"))


def summary(records: DataFrame, cfg: AuditConfig, runtime: float) -> DataFrame:
    """One-row nested summary (results array + run config)."""
    best = recommend(records)
    passed = records.where("overall_pass").limit(1).count() > 0
    res = records.withColumn("__order", F.col("config_order")).drop("config_order", "so_ci_lower", "so_ci_upper", "link_ci_lower", "link_ci_upper",
                       "so_n", "so_s", "so_c", "lk_n", "lk_s", "lk_c")
    res = res.withColumn("is_recommended", F.col("model") == F.lit(best) if best else F.lit(False))
    # one row per model: ordered as the report ranks them
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("composite_score"), F.asc("__order")))
    res = res.select(place.alias("__place"), F.struct(*[c for c in res.columns if c != "__order"]).alias("__row"))
    agg = res.agg(F.transform(F.sort_array(F.collect_list(F.struct("__place", "__row"))),
                              lambda x: x["__row"]).alias("results"))
    return agg.select(
        F.lit(best).cast("string").alias("recommended_model"), F.lit(bool(passed)).alias("threshold_passed"),
        F.lit(round(runtime, 1)).alias("total_runtime_seconds"), "results",
        # nested like the original document (VARIANT keeps the structure in to_json)
        F.parse_json(F.lit(json.dumps(cfg.run_config()))).alias("run_config"))
