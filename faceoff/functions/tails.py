"""Upper tails of the t, F and chi-square distributions for finished one-row test statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, front = 1e-300, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (front if abs(front) > tiny else tiny)
    c, h = 1.0, d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper_one(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def t_quantile(p: float, df: float) -> float:
    """Quantile for p > 0.5 by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if 1.0 - t_two_sided(mid, df) / 2.0 < p else (lo, mid)
    return (lo + hi) / 2.0


def _column(fn, *args: Column) -> Column:
    @F.pandas_udf("double")
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(*values) if not any(v != v or v is None for v in values) else None
                          for values in zip(*series, strict=True)], dtype="float64")
    return apply(*[a.cast("double") for a in args])


def t_p_value(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_upper, f, d1, d2)


def chi2_p_value(x: Column) -> Column:
    return _column(chi2_upper_one, x)


def t_upper_quantile(df: Column, p: float = 0.975) -> Column:
    return _column(lambda d: t_quantile(p, d) if d > 0 else None, df)
