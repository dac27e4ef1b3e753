"""Quantiles of the Beta distribution, for lower confidence bounds of trust.

Spark has no such function, so a vectorised Arrow UDF fills in; it only ever
runs over the (source, field) table, never over claims.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# Ship the functions below with the UDF, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _log_gamma(x):
    return np.array([math.lgamma(v) for v in x.flat]).reshape(x.shape)


def _tail_fraction(x, a, b):
    """Continued fraction of the incomplete beta function, evaluated front to back."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(t := 1.0 - (a + b) * x / (a + 1.0)) < tiny, tiny, t)
    total = d.copy()
    for m in range(1, 20000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            total = total * change
        if np.all(np.abs(change - 1.0) < 1e-15):
            return total
    raise ArithmeticError("the continued fraction of the incomplete beta function did not settle")


def beta_cdf(x, a, b):
    """P(Beta(a, b) <= x) for arrays of equal shape."""
    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    flip = x > (a + 1.0) / (a + b + 2.0)
    u, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore"):
        log_front = p * np.log(u) + q * np.log1p(-u) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)
    part = np.exp(log_front) * _tail_fraction(u, p, q) / p
    return np.where(flip, 1.0 - part, part)


def beta_ppf(prob, a, b):
    """The ``prob``-quantile of Beta(a, b): Newton steps kept inside a shrinking bracket."""
    a, b = (np.asarray(v, dtype=float) for v in (a, b))
    low, high = np.zeros_like(a), np.ones_like(a)
    x = a / (a + b)
    log_norm = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    for _ in range(100):
        gap = beta_cdf(x, a, b) - prob
        low, high = np.where(gap < 0, x, low), np.where(gap < 0, high, x)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            density = np.exp(log_norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
            step = x - gap / density
        inside = np.isfinite(step) & (step > low) & (step < high)
        nxt = np.where(inside, step, (low + high) / 2)
        if np.all(np.abs(nxt - x) <= 1e-12 * x):
            return nxt
        x = nxt
    raise ArithmeticError("the search for the beta quantile did not settle")


def beta_quantile(a: Column, b: Column, prob: float) -> Column:
    """Column form of :func:`beta_ppf`; meant for small tables."""

    @F.pandas_udf("double")
    def quantile(alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series(beta_ppf(prob, alpha.to_numpy(), beta.to_numpy()))

    return quantile(a, b)
