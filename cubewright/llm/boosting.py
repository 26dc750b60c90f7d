"""Gradient-boosted trees for a two-class problem, in numpy or from sums that tasks bring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class BoostedTrees:
    """Trees of depth two under logistic loss, then a logistic calibration of their sum.

    Each tree tests one feature at its root and one at either child, at the quantiles
    of the training rows.  ``calibrate`` fits a slope and an offset on other rows.
    """

    def __init__(self, trees: int = 40, rate: float = 0.3, bins: int = 16, least: int = 4):
        self.trees, self.rate, self.bins, self.least = trees, rate, bins, least
        self.base, self.slope, self.offset = 0.0, 1.0, 0.0
        self.nodes: list[tuple] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        cuts = [c[c < column.max()] for c, column in zip(cuts, x.T)]
        margin = np.full(len(x), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            gradient, weight = y - p, p * (1 - p) + 1e-6
            root = self._split(x, gradient, weight, cuts, np.ones(len(x), bool))
            if root is None:
                break
            left = x[:, root[0]] <= root[1]
            children = [self._split(x, gradient, weight, cuts, side) or (0, np.inf) for side in (left, ~left)]
            node = (root, *children)
            leaf = self._leaf(x, node)
            values = [
                float(self.rate * gradient[leaf == k].sum() / (weight[leaf == k].sum() + 1.0)) for k in range(4)
            ]
            self.nodes.append((node, np.array(values)))
            margin += self.nodes[-1][1][leaf]
        return self

    def fit_sums(self, share: float, cuts: list[np.ndarray], sums: Callable[[BoostedTrees, tuple | None], np.ndarray]) -> BoostedTrees:
        """The trees of ``fit`` for rows that never come together.

        share: of positive rows.  cuts: of each feature, in order.  ``sums`` gives what
        :meth:`histogram` adds up over all rows under the trees so far: for a root, or
        for the two sides of the root it is given.
        """
        share = float(np.clip(share, 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        for _ in range(self.trees):
            root = self._best(sums(self, None)[0], cuts)
            if root is None:
                break
            below = sums(self, root)
            children = [self._best(side, cuts) or (0, np.inf) for side in below]
            values = []
            for side, (f, c) in zip(below, children):
                low = side[f, : np.searchsorted(cuts[f], c) + 1].sum(axis=0) if np.isfinite(c) else side[0].sum(axis=0)
                values += [self.rate * g / (h + 1.0) for g, h, _ in (low, side[0].sum(axis=0) - low)]
            self.nodes.append(((root, *children), np.array(values)))
        return self

    def histogram(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, cuts: list[np.ndarray], root: tuple | None) -> np.ndarray:
        """(sides, features, bins, 3): gradient, weight and number of the rows, of which there are ``n`` each."""
        p = 1 / (1 + np.exp(-self.margin(x)))
        parts = np.stack([(y - p) * n, (p * (1 - p) + 1e-6) * n, n], axis=1)
        side = np.zeros(len(x), int) if root is None else (x[:, root[0]] > root[1]).astype(int)
        out = np.zeros((1 if root is None else 2, x.shape[1], self.bins + 1, 3))
        for f, points in enumerate(cuts):
            np.add.at(out[:, f], (side, np.searchsorted(points, x[:, f])), parts)
        return out

    def _best(self, side: np.ndarray, cuts: list[np.ndarray]) -> tuple | None:
        best, found = 1e-9, None
        g, h, n = side[0].sum(axis=0)
        for f, points in enumerate(cuts):
            for (gl, hl, nl), c in zip(side[f].cumsum(axis=0), points):
                if nl >= self.least and n - nl >= self.least:
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if gain > best:
                        best, found = gain, (f, float(c))
        return found

    def _split(self, x, gradient, weight, cuts, rows):
        best, found = 1e-9, None
        g, h = gradient[rows].sum(), weight[rows].sum()
        for f, points in enumerate(cuts):
            column = x[rows, f]
            for c in points:
                low = column <= c
                n = int(low.sum())
                if n < self.least or len(low) - n < self.least:
                    continue
                gl, hl = gradient[rows][low].sum(), weight[rows][low].sum()
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best:
                    best, found = gain, (f, float(c))
        return found

    @staticmethod
    def _leaf(x: np.ndarray, node: tuple) -> np.ndarray:
        (f, c), (fl, cl), (fr, cr) = node
        return np.where(x[:, f] <= c, np.where(x[:, fl] <= cl, 0, 1), np.where(x[:, fr] <= cr, 2, 3))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for node, values in self.nodes:
            out += values[self._leaf(x, node)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> BoostedTrees:
        """Fit the slope and offset of the probability on held-out rows by Newton's method."""
        if len(x) == 0 or y.min() == y.max():
            return self
        return self.calibrate_margins(self.margin(x), y, np.ones(len(x)), steps)

    def calibrate_margins(self, margin: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> BoostedTrees:
        """The same from sums of the trees, each of ``n`` rows."""
        if len(y) == 0 or y.min() == y.max():
            return self
        m = np.stack([margin, np.ones(len(margin))], axis=1)
        prior = np.array([1.0, 0.0])
        w = prior.copy()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-m @ w))
            gradient = m.T @ ((p - y) * n) + (w - prior)
            hessian = (m * (p * (1 - p) * n)[:, None]).T @ m + np.eye(2)
            w -= np.linalg.solve(hessian, gradient)
        self.slope, self.offset = float(w[0]), float(w[1])
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))
