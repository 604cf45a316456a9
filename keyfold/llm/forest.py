"""A small random forest: trained in numpy on a bounded table, applied as SQL expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gini(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = ones / np.maximum(n, 1)
    return n * 2 * p * (1 - p)


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, tries: int, rng: np.random.Generator):
    """A leaf (share of ones) or (feature, threshold, low side, high side)."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (_gini(np.array([y.sum()]), np.array([len(y)]))[0] - 1e-9, None, 0.0)
    for f in rng.permutation(x.shape[1])[:tries]:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (len(y) - n[:-1] >= least))
        if len(cut):
            cost = _gini(ones[cut], n[cut]) + _gini(ones[-1] - ones[cut], len(y) - n[cut])
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (cost[k], int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[low], y[low], depth - 1, least, tries, rng), _grow(x[~low], y[~low], depth - 1, least, tries, rng))


class Forest:
    def __init__(self, features: list[str], trees: list):
        self.features, self.trees = features, trees

    @classmethod
    def train(cls, features: list[str], x: np.ndarray, y: np.ndarray, trees: int = 31, depth: int = 7, least: int = 4, seed: int = 11) -> Forest:
        rng, tries = np.random.default_rng(seed), max(1, round(x.shape[1] ** 0.5) + 1)
        grown = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            grown.append(_grow(x[rows], y[rows].astype(float), depth, least, tries, rng))
        return cls(features, grown)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([sum(walk(t, row) for t in self.trees) / len(self.trees) for row in x])

    def column(self) -> Column:
        """The mean of the trees as nested conditions over the columns of the features."""

        def build(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            return F.when(F.col(self.features[node[0]]) <= F.lit(node[1]), build(node[2])).otherwise(build(node[3]))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + build(tree)
        return total / F.lit(float(len(self.trees)))
