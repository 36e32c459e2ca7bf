"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most `bins` bins at quantiles of the rows fitted on. A tree grows level by level: for every node and
feature the gradients and Hessians of the logistic loss are summed per bin (a histogram), and the cut with the largest gain
is taken. All trees end up in four flat arrays, in heap order, so a whole batch of rows walks a level of every tree in a
few array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Growth:
    """How the trees are grown."""

    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0  # added to the Hessian of a leaf
    least_hessian: float = 1.0  # of a child


@dataclass
class Trees:
    """`trees` complete binary trees of `depth`: node j has the children 2 j + 1 and 2 j + 2.

    A row goes right where its feature is above the cut; a node without a split has an infinite cut, so all rows go left.
    """

    base: float
    depth: int
    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray
    value: np.ndarray  # (trees, 2^depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[None, :]
        trees = np.arange(len(self.feature))[:, None]
        node = np.zeros((len(self.feature), len(x)), np.int32)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def constant(probability: float, depth: int = 1) -> Trees:
    """A model that gives every row the same score."""
    base = float(np.log(probability / (1 - probability)))
    return Trees(base, depth, np.zeros((0, 2**depth - 1), np.int32), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins: midpoints of distinct neighbours at quantiles, so a cut never depends on which side a value stands."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, growth: Growth = Growth()) -> Trees:
    """Trees for rows `x` with labels `y` (0 or 1). With one class only, or no rows, a constant."""
    share = y.mean() if len(y) else 0.5
    if not 0 < share < 1:
        return constant(float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-6, 1 - 1e-6)), growth.depth)
    n, width = x.shape
    edges = [_edges(x[:, f], growth.bins) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner, leaves = 2**growth.depth - 1, 2**growth.depth
    feature = np.zeros((growth.trees, inner), np.int32)
    cut = np.full((growth.trees, inner), np.inf)
    value = np.zeros((growth.trees, leaves))
    for t in range(growth.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(growth.depth):
            nodes = 2**level
            best = np.full(nodes, 1e-9)
            split = [None] * nodes
            for f in range(width):
                size = len(edges[f]) + 1
                if size == 1:
                    continue
                key = node * size + binned[:, f]
                left_g = np.bincount(key, g, nodes * size).reshape(nodes, size).cumsum(axis=1)
                left_h = np.bincount(key, h, nodes * size).reshape(nodes, size).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + growth.ridge) + right_g**2 / (right_h + growth.ridge) - all_g**2 / (all_h + growth.ridge)
                gain[(left_h < growth.least_hessian) | (right_h < growth.least_hessian)] = -1
                at = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(nodes), at]
                for j in np.flatnonzero(top > best):
                    best[j], split[j] = top[j], (f, at[j])
            right = np.zeros(n, bool)
            for j, found in enumerate(split):
                if found is not None:
                    f, at = found
                    feature[t, nodes - 1 + j], cut[t, nodes - 1 + j] = f, edges[f][at]
                    inside = node == j
                    right[inside] = binned[inside, f] > at
            node = 2 * node + right
        value[t] = growth.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + growth.ridge)
        margin += value[t][node]
    return Trees(base, growth.depth, feature, cut, value)
