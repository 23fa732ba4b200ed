"""Tail probabilities of the t, F and chi-square distributions.

Spark has no such functions.  They finish statistics that were already reduced to one row per
test, so the work here never grows with the data.  The incomplete beta function follows the
continued fraction of Lentz in its usual published form; the incomplete gamma function uses the
series below the mean and the continued fraction above it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    total = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + step / c
        c = c if abs(c) > _TINY else _TINY
        total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * total


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    if not (df1 > 0 and df2 > 0) or math.isnan(f):
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def chi2_tail(x: float, df: float) -> float:
    if not (df > 0) or math.isnan(x):
        return math.nan
    return upper_gamma(df / 2.0, x / 2.0)


def t_quantile(p: float, df: float) -> float:
    """Value below which Student's t falls with probability ``p``."""
    if not (df > 0):
        return math.nan
    if p == 0.5:
        return 0.0
    tail = 2.0 * (1.0 - p if p > 0.5 else p)
    low, high = 0.0, 1.0
    while t_tail(high, df) > tail:
        low, high = high, high * 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_tail(mid, df) > tail:
            low = mid
        else:
            high = mid
        if high - low <= 1e-14 * high:
            break
    value = (low + high) / 2.0
    return value if p > 0.5 else -value


def _mapped(fn, *series: pd.Series) -> pd.Series:
    arrays = [np.asarray(s, dtype="float64") for s in series]
    return pd.Series([fn(*row) for row in zip(*arrays)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(t_tail, t, df)


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _mapped(f_tail, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(chi2_tail, x, df)


@F.pandas_udf(T.DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(t_quantile, p, df)
