"""Regularised incomplete gamma function and gamma quantiles in numpy."""

from __future__ import annotations

import math

import numpy as np


def _lgamma(a: np.ndarray) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(a), float)  # made anew, as it can't be sent to tasks


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(a, x): a power series below a + 1, a continued fraction above, each only where it converges fast."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.where(x > 0, np.exp(a * np.log(np.where(x > 0, x, 1)) - x - _lgamma(a)), 0.0)
    low = (x > 0) & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term = total = 1 / al
        n = al.copy()
        for _ in range(100_000):
            n = n + 1
            term = term * xl / n
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        out[low] = total * front[low]
    high = (x > 0) & ~low
    if high.any():
        ah, xh = a[high], x[high]
        tiny = 1e-300
        b = xh + 1 - ah
        c, d = np.full_like(b, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            k = -i * (i - ah)
            b = b + 2
            d = k * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - front[high] * h
    return out


def gamma_quantile(p: float, shape: np.ndarray, scale: np.ndarray | float) -> np.ndarray:
    """Where the distribution function is p; NaN where shape or scale is missing or not positive."""
    shape, scale = np.broadcast_arrays(np.asarray(shape, float), np.asarray(scale, float))
    out = np.full(shape.shape, np.nan)
    ok = (shape > 0) & (scale > 0)
    a = shape[ok]
    if not len(a):
        return out
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    x = a * (1 - 1 / (9 * a) + z / (3 * np.sqrt(a))) ** 3  # Wilson and Hilferty
    small = np.exp((math.log(p) + _lgamma(a + 1)) / a)
    x = np.where((x > 0) & (a > 0.5), x, small)
    lo, hi = np.zeros_like(a), np.maximum(2 * x + 10, a + 40 * np.sqrt(a) + 40)
    for _ in range(60):
        f = gamma_cdf(a, x) - p
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        slope = np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) - x - _lgamma(a))
        step = np.where(slope > 0, f / np.where(slope > 0, slope, 1), 0)
        new = x - step
        new = np.where((new > lo) & (new < hi) & (slope > 0), new, (lo + hi) / 2)
        if (np.abs(new - x) <= 1e-14 * np.maximum(x, 1e-300)).all():
            x = new
            break
        x = new
    out[ok] = x * scale[ok]
    return out


def chi2_quantile(p: float, k: np.ndarray) -> np.ndarray:
    return gamma_quantile(p, np.asarray(k, float) / 2, 2.0)
