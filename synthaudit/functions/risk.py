"""Risk arithmetic of the attacks (G13): Wilson interval and residual risk.

Wilson score interval at 95 % for ``s`` successes of ``n``:
``rate = (s + z²/2)/(n + z²)``, ``err = z/(n + z²)·sqrt(s(n−s)/n + z²/4)``.
Residual risk of the attack over the control baseline:
``r = (a − c)/(1 − c)``, ``err_r = sqrt((e_a/(1−c))² + ((a−1)/(1−c)²·e_c)²)``,
value and bounds clipped to [0, 1].
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def wilson(s: float, n: float, z: float = Z95) -> tuple[float, float]:
    """Python form for the driver and tests: (rate, error)."""
    z2 = z * z
    rate = (s + z2 / 2.0) / (n + z2)
    err = z / (n + z2) * math.sqrt(s * (n - s) / n + z2 / 4.0)
    return rate, err


def residual_risk(s: float, c: float, n: float, n_control: float | None = None, z: float = Z95):
    """Return (risk, ci_lower, ci_upper) for attack successes ``s`` and
    control successes ``c`` (``n`` attacks each unless ``n_control``)."""
    if n <= 0:
        return 1.0, 1.0, 1.0
    a, ea = wilson(s, n, z)
    cr, ec = wilson(c, n_control or n, z)
    if cr >= 1.0:
        return 0.0, 0.0, 0.0
    r = (a - cr) / (1.0 - cr)
    er = math.sqrt((ea / (1.0 - cr)) ** 2 + ((a - 1.0) / (1.0 - cr) ** 2 * ec) ** 2)
    clip = lambda v: min(1.0, max(0.0, v))
    return clip(r), clip(r - er), clip(r + er)


def wilson_cols(s: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    z2 = F.lit(z * z)
    s = s.cast("double")
    n = n.cast("double")
    rate = (s + z2 / 2) / (n + z2)
    err = F.lit(z) / (n + z2) * F.sqrt(s * (n - s) / n + z2 / 4)
    return rate, err


def residual_risk_cols(s: Column, c: Column, n: Column, n_control: Column | None = None,
                       z: float = Z95) -> tuple[Column, Column, Column]:
    """Column form of :func:`residual_risk` (risk, ci_lower, ci_upper)."""
    a, ea = wilson_cols(s, n, z)
    cr, ec = wilson_cols(c, n if n_control is None else n_control, z)
    r = (a - cr) / (1 - cr)
    er = F.sqrt(F.pow(ea / (1 - cr), 2) + F.pow((a - 1) / F.pow(1 - cr, 2) * ec, 2))

    def clip(v):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    bad = n.cast("double") <= 0
    return (F.when(bad, 1.0).otherwise(clip(r)),
            F.when(bad, 1.0).otherwise(clip(r - er)),
            F.when(bad, 1.0).otherwise(clip(r + er)))
