"""A compact ARIMA(p, d, q) fit for one short series (NumPy), applied per series inside Spark tasks.

d: repeated differencing until the level-stationarity statistic is below its published 5 % value.
p, q: Hannan-Rissanen regressions, lowest AIC. Values differ from a maximum-likelihood fit.
"""

from __future__ import annotations

import numpy as np

KPSS_5_PERCENT = 0.463  # fixed value from the published table, level case


def kpss_level(y: np.ndarray) -> float:
    n = len(y)
    e = y - y.mean()
    lags = int(4 * (n / 100) ** 0.25)
    long_run = (e @ e) / n
    for lag in range(1, lags + 1):
        long_run += 2 / n * (1 - lag / (lags + 1)) * (e[lag:] @ e[:-lag])
    return float((np.cumsum(e) ** 2).sum() / (n * n * long_run)) if long_run > 1e-300 else 0.0


def _ols(x: np.ndarray, y: np.ndarray):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, y - x @ beta


def _lagged(v: np.ndarray, k: int, start: int) -> np.ndarray:
    return np.column_stack([v[start - i : len(v) - i] for i in range(1, k + 1)]) if k else np.empty((len(v) - start, 0))


def _stable(coef: np.ndarray) -> bool:
    return not len(coef) or bool(np.abs(np.roots(np.r_[1.0, -coef])).max() < 0.999)


def fit_arma(z: np.ndarray, max_p: int, max_q: int, constant: bool = True):
    """Best (intercept, ar, ma, residuals) by AIC over p <= max_p, q <= max_q, p + q <= 5; the intercept is 0 without `constant`."""
    n, c = len(z), int(constant)
    order = max(1, min(int(np.ceil(np.log(n) ** 2 / 2)), n // 4))
    rough = np.zeros(n)
    if n > order + 2:
        _, tail = _ols(np.column_stack([np.ones(n - order), _lagged(z, order, order)]), z[order:])
        rough[order:] = tail
    start = min(order + max_q, n // 3)
    level = z.mean() if constant else 0.0
    best = (np.inf, level, np.empty(0), np.empty(0), z - level)
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            s = max(start, p, q)
            rows = n - s
            if p + q > 5 or rows <= p + q + 2:
                continue
            beta, res = _ols(np.column_stack([np.ones((rows, c)), _lagged(z, p, s), _lagged(rough, q, s)]), z[s:]) if p + q + c else (np.empty(0), z[s:])
            ar, ma = beta[c : p + c], beta[p + c :]
            if not (_stable(ar) and _stable(-ma)):
                continue
            aic = rows * np.log(max(res @ res / rows, 1e-300)) + 2 * (p + q + c)
            aic *= n / rows  # candidates may use slightly different numbers of rows
            if aic < best[0] - 1e-9:
                eps = np.zeros(n)
                eps[s:] = res
                best = (aic, beta[0] if constant else 0.0, ar, ma, eps)
    return best[1:]


def arima_forecast(y: np.ndarray, steps: int, max_p: int = 5, max_q: int = 5, max_d: int = 2) -> np.ndarray:
    """Forecast `steps` values; under five points the last value (0 for none) is repeated."""
    y = np.asarray(y, dtype=float)
    if len(y) < 5:
        return np.full(steps, y[-1] if len(y) else 0.0)
    if np.ptp(y) == 0:
        return np.full(steps, y[-1])
    z, heads = y, []
    while len(heads) < max_d and len(z) > 5 and kpss_level(z) > KPSS_5_PERCENT:
        heads.append(z[-1])
        z = np.diff(z)
    if np.ptp(z) == 0:
        c, ar, ma, eps = (0.0 if len(heads) == 2 else z.mean()), np.empty(0), np.empty(0), np.zeros(len(z))
    else:
        c, ar, ma, eps = fit_arma(z, max_p, max_q, constant=len(heads) < 2)  # a mean of second differences would be a parabola
    past, shocks, out = list(z), list(eps), []
    for _ in range(steps):
        value = c + sum(a * past[-i - 1] for i, a in enumerate(ar)) + sum(m * shocks[-i - 1] for i, m in enumerate(ma))
        past.append(value)
        shocks.append(0.0)
        out.append(value)
    for head in reversed(heads):
        out = list(head + np.cumsum(out))
    return np.asarray(out)
