"""Run and loader configuration (defaults follow the original tool's run)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults that must equal the original tool's for the same results.
ID_PATTERNS = ("id", "_id", "uuid", "index", "row_num")
HIGH_CARDINALITY_THRESHOLD = 0.5
MIN_ROWS_AFTER_CLEANING = 50
PRIVACY_THRESHOLDS = {"singling_out": 0.10, "linkability": 0.10, "cmla": 0.10}
UTILITY_THRESHOLDS = {"logic_consistency": 0.70, "correlation_similarity": 0.70, "tstr_gap_max": 0.10}
SCORE_WEIGHTS = {"privacy": 0.50, "utility": 0.50}
# Shares of correlation, logic and 1 - gap in the composite utility, with and without TSTR.
UTILITY_SHARES = {"with_tstr": (0.25, 0.15, 0.60), "without": (0.50, 0.50)}


@dataclass(frozen=True)
class LoaderConfig:
    high_cardinality_threshold: float = HIGH_CARDINALITY_THRESHOLD
    min_rows_after_cleaning: int = MIN_ROWS_AFTER_CLEANING
    drop_id_patterns: tuple = ID_PATTERNS
    id_match: str = "substring"          # or "token" (decision D5)
    trim: str = "imputed"                # or "all" (decision D6)
    metadata_overrides: dict = field(default_factory=dict)


@dataclass(frozen=True)
class AuditConfig:
    max_rows: int | None = None           # None = no cap (decision D12)
    train_ratio: float = 0.5
    random_seed: int = 42
    models: dict = field(default_factory=lambda: {"copula": {}, "dptree": {"epsilon": 1.0}})
    privacy_thresholds: dict = field(default_factory=lambda: dict(PRIVACY_THRESHOLDS))
    utility_thresholds: dict = field(default_factory=lambda: dict(UTILITY_THRESHOLDS))
    score_weights: dict = field(default_factory=lambda: dict(SCORE_WEIGHTS))
    target_col: str | None = None
    n_attacks: int = 500
    n_clusters: int = 10
    kmeans_max_iter: int = 20             # rounds over all rows; a run that needs more says so in the notes
    kmeans_tol: float = 1e-4
    distance_percentile: float = 5.0
    calibration: str = "nearest_other"   # "nearest_other" | "literal" (decision D1)

    def run_config(self) -> dict:
        """Run configuration as written to the summary (without models)."""
        return {
            "max_rows": self.max_rows, "train_ratio": self.train_ratio,
            "random_seed": self.random_seed, "privacy_thresholds": self.privacy_thresholds,
            "utility_thresholds": self.utility_thresholds, "score_weights": self.score_weights,
            "target_col": self.target_col, "n_attacks": self.n_attacks,
        }
