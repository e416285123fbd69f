"""Tail probabilities of t, F, chi-square, r and z, as Arrow-batched functions.

Each is computed as a tail, never as one minus the other, by continued fractions and series of the incomplete beta and
gamma functions on whole columns. Impossible arguments give null."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

LOG_GAMMA = np.vectorize(lambda v: math.lgamma(v) if v > 0 else math.nan, otypes=[float])
ERFC = np.vectorize(math.erfc, otypes=[float])

#: Beyond these degrees of freedom no quantile, and no verdict, is given.
QUANTILE_DF, VERDICT_DF = 1e4, 1e5


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 20_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if not np.any(np.abs(d * c - 1) > 3e-16):
            break
    return h


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), given both x and y = 1 - x so that neither cancels."""
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, y)))
    with np.errstate(all="ignore"):
        front = np.exp(LOG_GAMMA(a + b) - LOG_GAMMA(a) - LOG_GAMMA(b) + a * np.log(x) + b * np.log(y))
        direct = x < (a + 1) / (a + b + 2)
        p, q, z = np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x, y)
        part = front * beta_fraction(p, q, z) / p
    out = np.where(direct, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, out))


def gamma_upper(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(s, x)."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + s * np.log(x) - LOG_GAMMA(s))
        term = total = 1 / s
        for n in range(1, 10_000):
            term = term * x / (s + n)
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * 1e-17):
                break
        low = 1 - front * total
        b, c = x + 1 - s, np.full_like(x, 1e300)
        d = 1 / np.where(b == 0, 1e-300, b)
        h = d
        for n in range(1, 10_000):
            k = -n * (n - s)
            b = b + 2
            d = k * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + k / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if not np.any(np.abs(d * c - 1) > 3e-16):
                break
    return np.where(x <= 0, 1.0, np.where(x < s + 1, low, front * h))


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-tailed p of t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        p = beta_tail(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))
    return np.where((df > 0) & np.isfinite(df) & np.isfinite(t), p, np.nan)


def f_tails(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower tail of F."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    ok = (f >= 0) & (df1 > 0) & (df2 > 0) & np.isfinite(f) & np.isfinite(df1) & np.isfinite(df2)
    with np.errstate(all="ignore"):
        x, y = df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f)
        upper, lower = beta_tail(df2 / 2, df1 / 2, x, y), beta_tail(df1 / 2, df2 / 2, y, x)
    return np.where(ok, upper, np.nan), np.where(ok, lower, np.nan)


def t_quantile(df: np.ndarray) -> np.ndarray:
    """The 0.975 quantile of t, by bisection on [0, 1000]; none above QUANTILE_DF."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1000.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = t_tail(mid, df) > 0.05
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where((df > 0) & (df <= QUANTILE_DF), (lo + hi) / 2, np.nan)


def nulls(values: np.ndarray) -> pd.Series:
    return pd.Series(values).replace({np.nan: None}).astype("float64")


@F.pandas_udf(T.DoubleType())
def t_two_tailed(t: pd.Series, df: pd.Series) -> pd.Series:
    return nulls(t_tail(t, df))


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return nulls(f_tails(f, df1, df2)[0])


@F.pandas_udf(T.DoubleType())
def f_lower(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return nulls(f_tails(f, df1, df2)[1])


@F.pandas_udf(T.DoubleType())
def f_two_tailed(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return nulls(np.minimum(1, 2 * np.minimum(*f_tails(f, df1, df2))))


@F.pandas_udf(T.DoubleType())
def chi_square_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    x, df = np.asarray(x, float), np.asarray(df, float)
    return nulls(np.where((x >= 0) & (df > 0) & np.isfinite(x), gamma_upper(np.where(df > 0, df / 2, 1), np.abs(x) / 2), np.nan))


@F.pandas_udf(T.DoubleType())
def r_two_tailed(r: pd.Series, df: pd.Series) -> pd.Series:
    r, df = np.asarray(r, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        t = r * np.sqrt(df / (1 - r * r))
    return nulls(np.where(np.abs(r) < 1, t_tail(np.where(np.isfinite(t), t, 0), df), np.nan))


@F.pandas_udf(T.DoubleType())
def z_two_tailed(z: pd.Series) -> pd.Series:
    return nulls(ERFC(np.abs(np.asarray(z, float)) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    return nulls(t_quantile(df))
