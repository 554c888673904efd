"""Gradient-boosted trees and logistic regression on training rows that fit the driver: samples, or counted examples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column is the constant."""
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass(frozen=True)
class BoostedTrees:
    """Trees as nested tuples ``(feature, cut, left, right)`` over values; left is ``x <= cut``."""

    base: float
    trees: tuple

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            self._add(tree, x, np.arange(len(x)), total)
        return total

    def _add(self, node, x: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
        if not isinstance(node, tuple):
            total[rows] += node
            return
        feature, cut, left, right = node
        goes_left = x[rows, feature] <= cut
        self._add(left, x, rows[goes_left], total)
        self._add(right, x, rows[~goes_left], total)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _tree(x, slope, curve, rows, depth: int, rate: float, least: float):
    """Second-order gains; cuts between the distinct values of each feature."""
    total_slope, total_curve = slope[rows].sum(), curve[rows].sum()
    best = (1e-6, None, None)
    for feature in range(x.shape[1]) if depth else ():
        values = x[rows, feature]
        order = np.argsort(values, kind="stable")
        s, c, v = slope[rows][order].cumsum(), curve[rows][order].cumsum(), values[order]
        can = np.flatnonzero((v[1:] > v[:-1]) & (c[:-1] > least) & (total_curve - c[:-1] > least))
        if len(can):
            gain = s[can] ** 2 / (c[can] + 1) + (total_slope - s[can]) ** 2 / (total_curve - c[can] + 1)
            at = gain.argmax()
            gained = gain[at] - total_slope**2 / (total_curve + 1)
            if gained > best[0]:
                best = (gained, feature, float(v[can[at]] + v[can[at] + 1]) / 2)
    if best[1] is None:
        return float(-rate * total_slope / (total_curve + 1))
    goes_left = x[rows, best[1]] <= best[2]
    grow = lambda part: _tree(x, slope, curve, part, depth - 1, rate, least)
    return (best[1], best[2], grow(rows[goes_left]), grow(rows[~goes_left]))


def boost(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0
) -> BoostedTrees:
    """Logistic loss; a row counts ``weight`` times, ``least`` is the smallest sum of curvatures in a leaf."""
    weight = np.ones(len(y)) if weight is None else weight
    share = min(max(float(np.average(y, weights=weight)) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    raw, trees = np.full(len(y), base), []
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        tree = _tree(x, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, rate, least)
        trees.append(tree)
        BoostedTrees(0.0, ())._add(tree, x, np.arange(len(y)), raw)
    return BoostedTrees(base, tuple(trees))
