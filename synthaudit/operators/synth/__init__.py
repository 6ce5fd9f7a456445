"""Synthesizers (N1–N4): fit on a DataFrame, sample a DataFrame."""

from synthaudit.operators.synth.base import REGISTRY, NotAvailable, Synthesizer, build  # noqa: F401
from synthaudit.operators.synth.copula import GaussianCopula  # noqa: F401
from synthaudit.operators.synth.dptree import DPTree  # noqa: F401
