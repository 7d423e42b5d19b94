"""Gradient-boosted regression trees and their Shapley values, in numpy, for one series at a time."""

from __future__ import annotations

import numpy as np


class Tree:
    """Arrays by node: feature (-1 at a leaf), cut (left if x <= cut), left, right, value, cover (rows at training)."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value, self.cover, self.gain = [], [], [], [], [], [], []

    def node(self, value: float, cover: float) -> int:
        for xs, x in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover), (self.gain, 0.0)):
            xs.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            k = at[inner]
            go = x[inner, feature[k]] <= cut[k]
            at[inner] = np.where(go, left[k], right[k])
        return np.array(self.value)[at]


class Booster:
    """Squared loss with L2 penalty on leaf values; rows and features are sampled per tree."""

    def __init__(self, trees: int = 200, depth: int = 6, rate: float = 0.1, rows: float = 0.8, features: float = 0.8, least: float = 3, l2: float = 1.0, seed: int = 42):
        self.n, self.depth, self.rate, self.rows, self.features, self.least, self.l2, self.seed = trees, depth, rate, rows, features, least, l2, seed
        self.trees: list[Tree] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        rng = np.random.default_rng(self.seed)
        self.base = float(y.mean())
        now = np.full(len(y), self.base)
        order = np.argsort(x, axis=0, kind="stable")
        for _ in range(self.n):
            use = np.zeros(len(y), bool)
            use[rng.permutation(len(y))[: max(1, round(self.rows * len(y)))]] = True
            cols = np.sort(rng.permutation(x.shape[1])[: max(1, round(self.features * x.shape[1]))])
            tree = Tree()
            self._grow(tree, x, y - now, order, use, cols, 0)
            self.trees.append(tree)
            now += tree.predict(x)
        return self

    def _grow(self, tree: Tree, x: np.ndarray, r: np.ndarray, order: np.ndarray, use: np.ndarray, cols: np.ndarray, level: int) -> int:
        n, total = int(use.sum()), float(r[use].sum())
        me = tree.node(self.rate * total / (n + self.l2), n)
        if level == self.depth or n < 2 * self.least:
            return me
        rows = order[:, cols][use[order[:, cols]]].reshape(n, -1) if use.all() else np.stack([o[use[o]] for o in order[:, cols].T], 1)
        values = x[rows, cols[None, :]]
        sums, counts = np.cumsum(r[rows], 0)[:-1], np.arange(1, n)[:, None]
        gain = sums**2 / (counts + self.l2) + (total - sums) ** 2 / (n - counts + self.l2) - total**2 / (n + self.l2)
        gain[(values[1:] == values[:-1]) | (counts < self.least) | (n - counts < self.least)] = -np.inf
        k = int(gain.argmax())
        i, j = divmod(k, len(cols))
        if not gain[i, j] > 1e-12:
            return me
        tree.feature[me], tree.cut[me], tree.gain[me] = int(cols[j]), float((values[i, j] + values[i + 1, j]) / 2), float(gain[i, j])
        go = x[:, cols[j]] <= tree.cut[me]
        tree.left[me] = self._grow(tree, x, r, order, use & go, cols, level + 1)
        tree.right[me] = self._grow(tree, x, r, order, use & ~go, cols, level + 1)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def importance(self, n: int) -> np.ndarray:
        """Mean gain per split of each feature, summing to 1."""
        gain, splits = np.zeros(n), np.zeros(n)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    gain[f] += g
                    splits[f] += 1
        mean = gain / np.maximum(splits, 1)
        return mean / mean.sum() if mean.sum() else np.full(n, 1 / n)

    def expected(self) -> float:
        """Mean prediction, by training cover."""
        return self.base + sum(_mean(t, 0) for t in self.trees)

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values, rows by features; with expected() they add up to the predictions."""
        phi = np.zeros(x.shape)
        for t in self.trees:
            for leaf_value, path in _paths(t):
                _leaf_shares(phi, x, leaf_value, path)
        return phi


def _mean(t: Tree, k: int) -> float:
    if t.feature[k] < 0:
        return t.value[k]
    a, b = t.left[k], t.right[k]
    return (t.cover[a] * _mean(t, a) + t.cover[b] * _mean(t, b)) / t.cover[k]


def _paths(t: Tree, k: int = 0, path: tuple = ()):
    """Each leaf's value, and its conditions: feature -> (over, up to, share of training rows that go this way)."""
    if t.feature[k] < 0:
        merged: dict[int, list[float]] = {}
        for f, lo, hi, share in path:
            have = merged.setdefault(f, [-np.inf, np.inf, 1.0])
            have[0], have[1], have[2] = max(have[0], lo), min(have[1], hi), have[2] * share
        yield t.value[k], merged
        return
    for child, lo, hi in ((t.left[k], -np.inf, t.cut[k]), (t.right[k], t.cut[k], np.inf)):
        yield from _paths(t, child, (*path, (t.feature[k], lo, hi, t.cover[child] / t.cover[k])))


def _leaf_shares(phi: np.ndarray, x: np.ndarray, value: float, path: dict[int, list[float]]) -> None:
    """Adds one leaf's part for all rows. A coalition of known features reaches the leaf with the product over path
    features of: known, whether the row meets the condition; unknown, the share that does. Coefficients of that
    product as a polynomial in known features give each feature's mean marginal over coalitions of each size."""
    m = len(path)
    if not m:
        return
    fs = list(path)
    meets = np.stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in fs], 1).astype(float)
    share = np.array([path[f][2] for f in fs])
    weight = np.array([1.0 / (m * _choose(m - 1, s)) for s in range(m)])
    for i in range(m):
        poly = np.zeros((len(x), m))
        poly[:, 0] = 1.0
        for done, j in enumerate(k for k in range(m) if k != i):
            new = poly * share[j]
            new[:, 1 : done + 2] += poly[:, : done + 1] * meets[:, j : j + 1]
            poly = new
        phi[:, fs[i]] += value * (meets[:, i] - share[i]) * (poly @ weight)


def _choose(n: int, k: int) -> float:
    from math import comb

    return float(comb(n, k))
