"""The incomplete beta function and what rests on it, in batches (Spark SQL has neither gamma nor beta)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.scalar import col

_log_gamma = np.frompyfunc(math.lgamma, 1, 1)
HALVINGS = 60


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta, by Lentz's method; quick for x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300

    def away(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    h, m = d.copy(), 0
    # needs about the square root of the larger parameter
    most = 100 + 10 * int(math.sqrt(max(a.max(initial=1.0), b.max(initial=1.0))))
    while m < most:
        m += 1
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                  -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + t * d), away(1 + t / c)
            h = h * d * c
        if np.abs(d * c - 1).max(initial=0.0) < 1e-15:
            break
    return h


def regularised_beta(x, a, b) -> np.ndarray:
    """I_x(a, b) for a, b > 0; 0 below 0 and 1 above 1."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    flip = inside > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inside, inside)
    log_beta = np.asarray(_log_gamma(a) + _log_gamma(b) - _log_gamma(a + b), float)
    part = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta) / p * _fraction(z, p, q)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(flip, 1 - part, part)))


def beta_inverse(p: float, a, b) -> np.ndarray:
    """x with I_x(a, b) = p, by halving."""
    a, b = (np.asarray(v, float) for v in np.broadcast_arrays(a, b))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        below = regularised_beta(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _known(fn, *columns: pd.Series) -> pd.Series:
    """`fn` of the rows in which all columns are positive; the others are null."""
    frame = pd.concat([c.astype(float) for c in columns], axis=1)
    good = (frame > 0).all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if good.any():
        out[good] = fn(*frame.to_numpy()[good].T)
    return pd.Series(out).astype(object).where(good, None)


def beta_quantile(p: float, a: str | Column, b: str | Column) -> Column:
    """Quantile of the beta distribution; null unless both parameters are positive."""

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        return _known(lambda u, v: beta_inverse(p, u, v), a, b)

    return quantile(col(a).cast("double"), col(b).cast("double"))


def student_tail(t: str | Column, df: str | Column) -> Column:
    """Two-sided Student tail probability to 13 digits; null unless df is positive."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, n: pd.Series) -> pd.Series:
        return _known(lambda u, v: regularised_beta(u, v / 2, 0.5), x, n)

    n = col(df).cast("double")
    return F.when(col(t) == 0, F.when(n > 0, 1.0)).otherwise(tail(n / (n + col(t) * col(t)), n))
