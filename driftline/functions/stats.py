"""Tail probabilities and clamps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def clamp_p(p: Column) -> Column:
    """A usable p-value: missing, NaN or infinite becomes 1, the rest is held to [0, 1]."""
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == F.lit(float("inf")))
    return F.when(bad, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def clamp_f(f: Column) -> Column:
    """A usable F statistic: missing, NaN, infinite or negative becomes 0."""
    bad = f.isNull() | F.isnan(f) | (F.abs(f) == F.lit(float("inf"))) | (f < 0)
    return F.when(bad, F.lit(0.0)).otherwise(f)


def f_tail_even(f: Column, d1: int, d2: Column) -> Column:
    """P(F > f) for an even first degree of freedom: a finite sum, so it stays a plain expression."""
    if d1 % 2:
        raise ValueError("closed form needs an even first degree of freedom")
    x = d2 / (d2 + d1 * f)
    a = d2 / 2
    term, acc = F.lit(1.0), F.lit(1.0)
    for j in range(1, d1 // 2):
        term = term * (a + (j - 1)) / j * (1 - x)
        acc = acc + term
    return F.pow(x, a) * acc


def _lgamma(values: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in values])


def beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, for whole arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 0.0, 1.0)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for step in (even, odd):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f) for any degrees of freedom."""
    f = np.asarray(f, dtype=float)
    d1, d2 = np.broadcast_to(np.asarray(d1, float), f.shape), np.broadcast_to(np.asarray(d2, float), f.shape)
    out = np.full(f.shape, np.nan)
    ok = np.isfinite(f) & (f >= 0) & (d1 > 0) & (d2 > 0)
    out[ok] = beta_tail(d2[ok] / 2, d1[ok] / 2, d2[ok] / (d2[ok] + d1[ok] * f[ok]))
    out[np.isposinf(f)] = 0.0
    return out


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F > f), Arrow batches; only ever applied to bin-level or pair-level results."""
    return pd.Series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return f_tail((t * t).cast("double"), F.lit(1.0), df.cast("double"))
