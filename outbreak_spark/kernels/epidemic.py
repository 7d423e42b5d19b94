"""SEIR curves by an adaptive Runge-Kutta pair, for many scenarios at once, and simplex search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# The Dormand-Prince 5(4) pair.
_A = [[], [1 / 5], [3 / 40, 9 / 40], [44 / 45, -56 / 15, 32 / 9], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656]]
_B5 = np.array([35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0])
_B4 = np.array([5179 / 57600, 0, 7571 / 16695, 393 / 640, -92097 / 339200, 187 / 2100, 1 / 40])


def _slope(y: np.ndarray, beta, sigma, gamma, n) -> np.ndarray:
    s, e, i = y[0], y[1], y[2]
    force = np.maximum(beta * s * i / n, 0.0)
    return np.stack([-force, force - sigma * e, sigma * e - gamma * i, gamma * i])


def seir(beta, sigma, gamma, n, start: np.ndarray, days: int, tol: float = 1e-8) -> np.ndarray:
    """S, E, I, R of scenarios (columns) at days 0 .. days: an array (days + 1, 4, scenarios)."""
    beta, sigma, gamma, n = (np.atleast_1d(np.asarray(v, float)) for v in (beta, sigma, gamma, n))
    if (beta < 0).any() or (sigma < 0).any() or (gamma < 0).any() or (n <= 0).any():
        raise ValueError("rates must not be negative, and populations must be positive")
    y, h, out = np.array(start, float).reshape(4, -1), 0.1, [np.array(start, float).reshape(4, -1)]
    f = lambda v: _slope(v, beta, sigma, gamma, n)
    for _ in range(days):
        left = 1.0
        while left > 1e-12:
            h = min(h, left)
            k = [f(y)]
            for row in _A[1:]:
                k.append(f(y + h * sum(a * b for a, b in zip(row, k, strict=True))))
            five = y + h * sum(b * x for b, x in zip(_B5[:6], k, strict=True))
            k.append(f(five))
            error = h * sum((a - b) * x for a, b, x in zip(_B5, _B4, k, strict=True))
            norm = float(np.max(np.sqrt(np.mean((error / (tol + tol * np.maximum(np.abs(y), np.abs(five)))) ** 2, axis=0))))
            if not np.isfinite(norm) or (norm > 1 and h < 1e-6):
                raise ArithmeticError("the scenario can't be integrated")
            if norm <= 1:
                y, left = five, left - h
            h *= min(5.0, max(0.2, 0.9 * max(norm, 1e-10) ** -0.2))
        out.append(y)
    return np.stack(out)


def daily_infections(beta, sigma, gamma, n, infected, days: int, steps: int = 8) -> np.ndarray:
    """incidence() of many scenarios (columns), a row per day 0 .. days, by fixed fourth-order steps: for searches that need
    many curves."""
    beta, sigma, gamma, n, infected = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (beta, sigma, gamma, n, infected)))
    rate, h, m = beta / n, 1 / steps, len(beta)
    y, out = np.stack([n - infected, np.zeros(m), infected]), np.zeros((days + 1, m))
    k, at, total = np.empty((3, m)), np.empty((3, m)), np.empty((3, m))

    def slope(v: np.ndarray) -> np.ndarray:
        force = np.maximum(rate * v[0] * v[2], 0.0)
        moved = sigma * v[1]
        np.negative(force, out=k[0])
        np.subtract(force, moved, out=k[1])
        np.subtract(moved, gamma * v[2], out=k[2])
        return k

    with np.errstate(over="ignore", invalid="ignore"):
        for day in range(1, days + 1):
            before = y[0].copy()
            for _ in range(steps):
                np.copyto(total, slope(y))
                for ahead, weight in ((h / 2, 2.0), (h / 2, 2.0), (h, 1.0)):
                    np.multiply(k, ahead, out=at)
                    at += y
                    slope(at)
                    total += k * weight if weight != 1.0 else k
                total *= h / 6
                y += total
            np.maximum(before - y[0], 0.0, out=out[day])
    return out


def incidence(curve: np.ndarray) -> np.ndarray:
    """New infections of each day: what S loses, none on the first, never negative."""
    s = curve[:, 0]
    return np.concatenate([np.zeros((1, s.shape[1])), np.maximum(s[:-1] - s[1:], 0.0)])


def nelder_mead(f: Callable[[np.ndarray, np.ndarray], np.ndarray], start, count: int, most: int = 2000, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Local minima of `count` functions in lock-step, by reflection, expansion, contraction and shrinking of a simplex each.

    f(which, points): values of the functions of those numbers, each at its points (functions x points x dimensions). Every
    round asks for all four points that a simplex may move to at once; functions that have converged are dropped.
    """
    x, dims = np.array(start, float), len(start)
    corner = np.stack([x] + [np.where(np.arange(dims) == k, np.where(x != 0, 1.05 * x, 0.00025), x) for k in range(dims)])
    points, live = np.repeat(corner[None], count, 0), np.arange(count)
    values = f(live, points) if count else np.zeros((0, dims + 1))
    found, least = np.zeros((count, dims)), np.zeros(count)
    steps = np.array([1.0, 2.0, 0.5, -0.5])
    for turn in range(most + 1):
        order = np.argsort(values, axis=1, kind="stable")
        points, values = np.take_along_axis(points, order[:, :, None], 1), np.take_along_axis(values, order, 1)
        done = (np.abs(points[:, 1:] - points[:, :1]).max((1, 2)) <= tol) & (np.abs(values[:, -1] - values[:, 0]) <= tol) if turn < most else np.ones(len(live), bool)
        found[live[done]], least[live[done]] = points[done, 0], values[done, 0]
        points, values, live = points[~done], values[~done], live[~done]
        if not len(live):
            break
        centre, rows = points[:, :-1].mean(1), np.arange(len(live))
        tried = centre[:, None] + steps[:, None] * (centre - points[:, -1])[:, None]
        v = f(live, tried)
        inner = np.where(v[:, 0] < values[:, -1], 2, 3)
        best, second = v[:, 0] < values[:, 0], v[:, 0] < values[:, -2]
        contracted = v[rows, inner] < np.minimum(v[:, 0], values[:, -1])
        pick = np.select([best & (v[:, 1] < v[:, 0]), best | second, contracted], [1, 0, inner], -1)
        move, shrink = np.flatnonzero(pick >= 0), np.flatnonzero(pick < 0)
        points[move, -1], values[move, -1] = tried[move, pick[move]], v[move, pick[move]]
        if len(shrink):
            points[shrink, 1:] = points[shrink, :1] + 0.5 * (points[shrink, 1:] - points[shrink, :1])
            values[shrink, 1:] = f(live[shrink], points[shrink, 1:])
    return found, least
