"""Tail probabilities for the test statistics (no SciPy): chi-square, Student t,
Fisher's exact test. Vectorised pandas UDFs run them on per-pair result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution with integer ``dof`` (closed form)."""
    if x is None or dof is None or (isinstance(x, float) and math.isnan(x)) or dof <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return min(1.0, math.exp(-half) * total)
    total = math.erfc(math.sqrt(half))
    # odd dof: add exp(-x/2) * sum_{i=0}^{(dof-3)/2} (x/2)^(i+1/2) / Gamma(i + 3/2)
    log_half = math.log(half)
    for i in range((dof - 1) // 2):
        total += math.exp(-half + (i + 0.5) * log_half - math.lgamma(i + 1.5))
    return min(1.0, total)


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 1e-15
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(ln_front) * _betacf(a, b, x) / a
    return 1.0 - math.exp(ln_front) * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p for [[a, b], [c, d]]: tables at most as likely as the observed."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    lo, hi = max(0, c1 - r2), min(r1, c1)

    def logp(x: int) -> float:
        return (math.lgamma(r1 + 1) - math.lgamma(x + 1) - math.lgamma(r1 - x + 1)
                + math.lgamma(r2 + 1) - math.lgamma(c1 - x + 1) - math.lgamma(r2 - c1 + x + 1)
                - math.lgamma(n + 1) + math.lgamma(c1 + 1) + math.lgamma(n - c1 + 1))

    ks = np.arange(lo, hi + 1)
    lp = np.array([logp(int(k)) for k in ks])
    obs = logp(a)
    keep = lp <= obs + 1e-7 * abs(obs) + 1e-12
    return float(min(1.0, np.exp(lp[keep]).sum()))


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), int(k)) if pd.notna(a) and pd.notna(k) else float("nan")
                      for a, k in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def t_two_sided_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(k)) if pd.notna(a) and pd.notna(k) else float("nan")
                      for a, k in zip(t, dof)])


@F.pandas_udf(T.DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(int(w), int(x), int(y), int(z)) if pd.notna(w) else float("nan")
                      for w, x, y, z in zip(a, b, c, d)])
