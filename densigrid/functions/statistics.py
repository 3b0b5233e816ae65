"""Tail probabilities that Spark has no function for, over arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def beta_share(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction; on the other side of the mean through 1 - I_(1-x)(b, a)."""
    x, a = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(a, dtype=float))
    b = np.full(x.shape, float(b))
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(x.shape), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + term * d), safe(1 + term / c)
            out = out * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    found = np.where(x <= 0, 0.0, front * out)
    return np.where(swap, 1 - found, found)


def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """The chance of a Student t of ``df`` degrees of freedom at least so far from 0."""
    t, df = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    return pd.Series(np.clip(beta_share(df / (df + t * t), df / 2, 0.5), 0, 1)) if len(t) else pd.Series([], dtype=float)
