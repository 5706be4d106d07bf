"""Student-t tail probabilities.

Used only on aggregated rows (one per test), through an Arrow-batched pandas UDF.
The regularised incomplete beta function is evaluated by its continued fraction
(modified Lentz), the standard numerical method.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_cf(a: float, b: float, x: float, max_iter: int = 500, eps: float = 1e-15) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        num = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        num = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def reg_inc_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def student_t_two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with `df` degrees of freedom (df may be fractional)."""
    if t is None or df is None or not np.isfinite(df) or df <= 0 or np.isnan(t):
        return float("nan")
    if np.isinf(t):
        return 0.0
    return reg_inc_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def _student_t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    out = [student_t_two_sided_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b))
           for a, b in zip(t, df)]
    return pd.Series(out, dtype="float64")


def student_t_p(t, df) -> Column:
    """H15 as a column; NaN results become NULL. Apply to aggregated rows only."""
    tc = F.col(t) if isinstance(t, str) else t
    dc = F.col(df) if isinstance(df, str) else df
    p = _student_t_p_udf(tc.cast("double"), dc.cast("double"))
    return F.nanvl(p, F.lit(None).cast("double"))
