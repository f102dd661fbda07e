"""Gradient-boosted trees in numpy: histogram training with monotonic constraints, flat node arrays to score with."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class FlatTrees:
    """All trees one after another; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class _Nodes:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float) -> int:
        i = len(self.value)
        for column, x in zip((self.feature, self.threshold, self.left, self.right, self.value), (0, np.inf, i, i, value)):
            column.append(x)
        return i


def fit(x: np.ndarray, y: np.ndarray, increasing: tuple[int, ...] = (), trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: int = 20) -> FlatTrees:
    """Logistic boosting of ``y`` (0 or 1); the margin never falls as a feature of ``increasing`` rises."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1) if n else np.zeros((0, d), int)
    rate_of_ones = min(max(float(y.mean()) if n else 0.5, 1e-4), 1 - 1e-4)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    margin = np.full(n, base)
    nodes, roots = _Nodes(), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j in range(d):
                if not len(edges[j]):
                    continue
                size = len(edges[j]) + 1
                gs, hs, ns = (np.bincount(binned[rows, j], weights=w, minlength=size).cumsum()[:-1] for w in (g[rows], h[rows], None))
                left, right = -gs / (hs + ridge), -(total_g - gs) / (total_h - hs + ridge)
                left, right = np.clip(left, low, high), np.clip(right, low, high)
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                allowed = (ns >= least) & (len(rows) - ns >= least)
                if j in increasing:
                    allowed &= left <= right
                gain = np.where(allowed, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, left[k], right[k]))
        i = nodes.leaf(rate * value)
        if best[1] is None:
            margin[rows] += rate * value
            return i
        j, k, left, right = best[1]
        nodes.feature[i], nodes.threshold[i] = j, float(edges[j][k])
        middle = (left + right) / 2 if j in increasing else None
        goes = binned[rows, j] <= k
        nodes.left[i] = grow(rows[goes], g, h, level + 1, low, high if middle is None else middle)
        nodes.right[i] = grow(rows[~goes], g, h, level + 1, low if middle is None else middle, high)
        return i

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -4.0, 4.0))
    as_int = lambda v: np.array(v, dtype=np.int64)
    return FlatTrees(as_int(nodes.feature), np.array(nodes.threshold, dtype=float), as_int(nodes.left), as_int(nodes.right), np.array(nodes.value, dtype=float), as_int(roots), depth, base)
