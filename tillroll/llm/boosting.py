"""Gradient-boosted regression trees for a small table, and the scores they give."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        columns = (self.feature, self.cut, self.left, self.right, self.value)
        for column, empty in zip(columns, (-1, 0.0, 0, 0, value)):
            column.append(empty)
        return len(self.value) - 1

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return np.array(self.value)[node]
            at = node[inner]
            node[inner] = np.where(rows[inner, feature[at]] <= cut[at], left[at], right[at])


@dataclass
class BoostedTrees:
    """Logistic boosting: each tree fits the gradient by Newton steps."""

    trees: int = 30
    depth: int = 3
    rate: float = 0.3
    least: int = 5  # rows in a leaf
    shrink: float = 1.0
    base: float = 0.0
    fitted: list[Tree] = field(default_factory=list)

    def fit(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> BoostedTrees:
        weights = np.ones(len(rows)) if weights is None else weights
        share = np.clip(np.average(labels, weights=weights), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(rows), self.base)
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, 33)[1:-1])) for column in rows.T]
        for _ in range(self.trees):
            chance = 1 / (1 + np.exp(-score))
            tree = Tree()
            gradient, weight = weights * (labels - chance), weights * chance * (1 - chance)
            self._grow(tree, rows, gradient, weight, np.arange(len(rows)), cuts, self.depth)
            self.fitted.append(tree)
            score += tree.predict(rows)
        return self

    def _grow(self, tree: Tree, rows, gradient, weight, at, cuts, depth) -> int:
        total, mass = gradient[at].sum(), weight[at].sum() + self.shrink
        node = tree.add(float(self.rate * total / mass))
        best = (1e-9, -1, 0.0)
        for feature in range(rows.shape[1]) if depth else ():
            if not len(cuts[feature]):
                continue
            place = np.searchsorted(cuts[feature], rows[at, feature], side="left")  # bin i: value <= cut i
            bins = len(cuts[feature]) + 1
            sums, masses, counts = (
                np.bincount(place, values, bins)[:-1].cumsum()
                for values in (gradient[at], weight[at], np.ones(len(at)))
            )
            gain = sums**2 / (masses + self.shrink) + (total - sums) ** 2 / (mass - masses) - total**2 / mass
            gain[(counts < self.least) | (len(at) - counts < self.least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), feature, cuts[feature][gain.argmax()])
        if best[1] >= 0:
            _, tree.feature[node], tree.cut[node] = best
            low = rows[at, best[1]] <= best[2]
            tree.left[node] = self._grow(tree, rows, gradient, weight, at[low], cuts, depth - 1)
            tree.right[node] = self._grow(tree, rows, gradient, weight, at[~low], cuts, depth - 1)
        return node

    def chance(self, rows: np.ndarray) -> np.ndarray:
        score = np.full(len(rows), self.base)
        for tree in self.fitted:
            score += tree.predict(rows)
        return 1 / (1 + np.exp(-score))
