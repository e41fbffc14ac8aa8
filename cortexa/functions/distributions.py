"""Tail probabilities as vectorised functions of columns."""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral, by the modified Lentz scheme."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(v := 1 - (a + b) * x / (a + 1)) < tiny, tiny, v)
    h = d.copy()
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(v := 1 + term * d) < tiny, tiny, v)
            c = np.where(np.abs(v := 1 + term / c) < tiny, tiny, v)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    log = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a.ravel(), b.ravel(), strict=True)]).reshape(x.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log + a * np.log(x) + b * np.log1p(-x))
        low = front * _beta_fraction(a, b, x) / a
        high = 1 - front * _beta_fraction(b, a, 1 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), low, high)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / (df + t * t), df / 2, np.full_like(df, 0.5))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    from math import erfc, sqrt

    return np.array([0.5 * erfc(-v / sqrt(2)) for v in np.asarray(z, float)])


def _where_known(function, *columns: pd.Series) -> pd.Series:
    table = pd.concat([c.astype(float) for c in columns], axis=1)
    known = table.notna().all(axis=1).to_numpy()
    out = np.full(len(table), np.nan)
    if known.any():
        out[known] = function(*(table.iloc[:, i].to_numpy()[known] for i in range(table.shape[1])))
    return pd.Series(out).where(~np.isnan(out), None).astype(float)


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; null where t or df is."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return _where_known(t_two_sided, t, df)

    return p(t.cast("double"), df.cast("double"))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return _where_known(f_upper, f, d1, d2)

    return p(f.cast("double"), d1.cast("double"), d2.cast("double"))


def normal_pvalue(z: Column) -> Column:
    """Two-sided p of a standard normal."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return _where_known(lambda v: 2 * normal_cdf(-np.abs(v)), z)

    return p(z.cast("double"))


def normal_quantile(p: Column) -> Column:
    @F.pandas_udf("double")
    def q(p: pd.Series) -> pd.Series:
        from statistics import NormalDist

        return _where_known(lambda v: np.array([NormalDist().inv_cdf(x) if 0 < x < 1 else np.nan for x in v]), p)

    return q(p.cast("double"))


@lru_cache(maxsize=256)
def rank_sum_tail(n1: int, n2: int) -> np.ndarray:
    """The share of all orders of n1 and n2 different values in which U is at least 0, 1, ... n1 * n2.

    The numbers of orders are the coefficients of a Gaussian binomial; they are
    found by multiplying with (1 - q^(n2 + k)) / (1 - q^k) for k up to n1, as
    shares, so that no number grows too large.
    """
    small, large = sorted((n1, n2))
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    for k in range(1, small + 1):
        step = large + k
        if step < len(counts):
            counts[step:] -= counts[:-step].copy()
        for first in range(min(k, len(counts))):  # divided by 1 - q^k: sums over every k-th number
            counts[first::k] = np.cumsum(counts[first::k])
        counts *= k / (large + k)
    half = counts[: len(counts) // 2 + 1]  # the other half is its mirror image, and free of rounding errors only so
    counts = np.concatenate([half, half[: len(counts) - len(half)][::-1]])
    return np.minimum(1.0, np.cumsum(counts[::-1])[::-1] / counts.sum())


def exact_u_pvalue(u: Column, n1: Column, n2: Column) -> Column:
    """Two-sided exact p of the larger U of two groups without ties; keys with the same sizes share one distribution."""

    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        values = [None if pd.isna(x) or not (a > 0 and b > 0) else min(1.0, 2 * rank_sum_tail(int(a), int(b))[int(np.ceil(x))]) for x, a, b in zip(u, n1, n2, strict=True)]
        return pd.Series(values, dtype=float)

    return p(u.cast("double"), n1.cast("double"), n2.cast("double"))
