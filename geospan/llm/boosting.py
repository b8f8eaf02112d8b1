"""Gradient-boosted trees for two classes, and isotonic calibration.

Fitted on a bounded sample that the caller has gathered; scored in batches of
feature rows wherever the data is.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting on binned features."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 1.0,
                 least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """``x``: rows of features; ``y``: 0 or 1. Without rows, or of one class, the score is constant."""
        y = np.asarray(y, float)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.forest = float(np.log(share / (1 - share))), []
        if not len(y) or share * (len(y) + 1) < 1 or y.all():
            self.edges = []
            return self
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, quantiles)) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(code, p - y, p * (1 - p))
            self.forest.append(tree)
            margin += self._leaf(tree, code)
        return self

    def _grow(self, code, grad, hess):
        """Splits of a full tree, level by level: feature and bin per node, value per leaf."""
        node = np.zeros(code.shape[1], int)
        feature, cut = np.zeros(2 ** self.depth - 1, int), np.full(2 ** self.depth - 1, self.bins)
        for level in range(self.depth):
            n, first = 2 ** level, 2 ** level - 1
            best = np.full(n, 1e-6)
            for f, c in enumerate(code):
                at = node * self.bins + c
                g = np.bincount(at, grad, n * self.bins).reshape(n, -1).cumsum(1)
                h = np.bincount(at, hess, n * self.bins).reshape(n, -1).cumsum(1)
                k = np.bincount(at, minlength=n * self.bins).reshape(n, -1).cumsum(1)
                whole = g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                gain = (g ** 2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge) - whole)
                gain[(k < self.least) | (k[:, -1:] - k < self.least)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(n), b]
                better = top > best
                best = np.where(better, top, best)
                feature[first:first + n][better], cut[first:first + n][better] = f, b[better]
            node = node * 2 + (code[feature[first + node], np.arange(len(node))] > cut[first + node])
        leaves = 2 ** self.depth
        value = -self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge)
        return feature, cut, value

    def _leaf(self, tree, code):
        feature, cut, value = tree
        node = np.zeros(code.shape[1], int)
        for level in range(self.depth):
            at = 2 ** level - 1 + node
            node = node * 2 + (code[feature[at], np.arange(len(node))] > cut[at])
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        margin = np.full(len(x), self.base)
        if self.forest:
            code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])
            for tree in self.forest:
                margin += self._leaf(tree, code)
        return 1 / (1 + np.exp(-margin))


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), increasing, to interpolate between."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # label sum, rows, first and last score
    for s, y in zip(score[order], label[order]):
        blocks.append([float(y), 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2]
                                   or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            y2, n2, _, hi = blocks.pop()
            blocks[-1][0] += y2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    p = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return at, p


def calibrated(knots: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    return np.interp(score, *knots)
