"""Attack result schema and the fail-safe result."""

from __future__ import annotations

from dataclasses import astuple, dataclass

ATTACK_SCHEMA = ("attack_name string, risk_score double, ci_lower double, ci_upper double, "
                 "n_attacks_run bigint, passed_threshold boolean, notes string")


@dataclass
class AttackResult:
    attack_name: str
    risk_score: float
    ci_lower: float
    ci_upper: float
    n_attacks_run: int
    passed_threshold: bool
    notes: str = ""
    n_success: int | None = None
    n_control_success: int | None = None

    def row(self):
        return astuple(self)[:7]

    def with_threshold(self, threshold: float) -> "AttackResult":
        """Decision D4: fill ``passed_threshold`` (inclusive)."""
        self.passed_threshold = bool(self.risk_score <= threshold)
        return self


def failed_result(name: str, reason: str) -> AttackResult:
    """Max-risk result when an attack cannot run (fail safe)."""
    return AttackResult(name, 1.0, 1.0, 1.0, 0, False, f"FAILED: {reason}")


def to_frame(spark, results: list[AttackResult]):
    return spark.createDataFrame([r.row() for r in results], ATTACK_SCHEMA)
