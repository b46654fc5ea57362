"""Gradient-boosted trees for a yes-or-no answer, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic loss, Newton leaf weights, exact splits on small tables."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    ridge: float = 1.0
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth, cuts)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, x, gradient, hessian, rows, depth, cuts):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        for j, edges in enumerate(cuts if depth else ()):
            for edge in edges:
                low = rows[x[rows, j] <= edge]
                if 0 < len(low) < len(rows):
                    gl, hl = gradient[low].sum(), hessian[low].sum()
                    gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                    if gain > best[0]:
                        best = (gain, j, edge)
        if best[1] is None:
            return float(-self.rate * g / (h + self.ridge))
        _, j, edge = best
        side = x[rows, j] <= edge
        return j, float(edge), self._grow(x, gradient, hessian, rows[side], depth - 1, cuts), self._grow(x, gradient, hessian, rows[~side], depth - 1, cuts)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, edge, low, high = tree
        side = x[:, j] <= edge
        return np.where(side, self._walk(low, x), self._walk(high, x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for tree in self.trees:
            margin += self._walk(tree, x)
        return 1 / (1 + np.exp(-margin))


def calibrated_threshold(scores: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The least threshold from which on the precision holds, halfway to the next
    lower score; above 1 if none does."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    ranked = scores[order]
    # equal scores stand or fall together
    last = np.append(ranked[1:] != ranked[:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    if not len(good) or not truth.any():
        return 1.01
    k = good[-1]
    return float((ranked[k] + ranked[k + 1]) / 2) if k + 1 < len(ranked) else float(ranked[k])
