"""Gradient-boosted regression trees with logistic loss, and isotonic calibration, in numpy.

Fitted on the driver over a sample of bounded size (see ``toxicity``); a fitted
model is a few kilobytes and scores batches inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Tree:
    """A complete binary tree: split feature and bin per inner node, value per leaf."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            at = 2 * at + 1 + (binned[rows, self.feature[at]] > self.cut[at])
        return at - (2 ** self.depth - 1)


@dataclass
class BoostedTrees:
    n_trees: int = 60
    depth: int = 3
    rate: float = 0.15
    n_bins: int = 32
    ridge: float = 1.0
    min_rows: float = 10.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        quantiles = np.linspace(0, 1, self.n_bins + 1)[1:-1]
        self.edges = []
        for j in range(x.shape[1]):
            e = np.unique(np.quantile(x[:, j], quantiles))
            # a feature that is mostly one value still gets cuts among its other values
            rest = x[x[:, j] > e[0], j]
            self.edges.append(np.unique(np.append(e, np.quantile(rest, quantiles)) if len(rest) else e))
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = sigmoid(raw)
            tree = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            raw += tree.value[tree.leaves(binned)]
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> Tree:
        n_inner, bins = 2 ** self.depth - 1, 2 * self.n_bins + 2
        feature, cut = np.zeros(n_inner, np.int64), np.full(n_inner, bins, np.int64)
        at = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            first, n = 2 ** level - 1, 2 ** level
            best = np.full(n, 1e-12)
            for j in range(binned.shape[1]):
                cell = (at - first) * bins + binned[:, j]
                g, h, c = (np.bincount(cell, weights=w, minlength=n * bins).reshape(n, bins).cumsum(axis=1)
                           for w in (grad, hess, np.ones_like(grad)))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g ** 2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt ** 2 / (ht + self.ridge)
                gain[(c < self.min_rows) | (ct - c < self.min_rows)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(n), k]
                better = top > best
                best[better] = top[better]
                feature[first:first + n][better] = j
                cut[first:first + n][better] = k[better]
            at = 2 * at + 1 + (binned[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - n_inner
        g = np.bincount(leaf, weights=grad, minlength=n_inner + 1)
        h = np.bincount(leaf, weights=hess, minlength=n_inner + 1)
        return Tree(self.depth, feature, cut, self.rate * g / (h + self.ridge))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x):
            binned = self._binned(x)
            for t in self.trees:
                out += t.value[t.leaves(binned)]
        return out


@dataclass
class Isotonic:
    """A non-decreasing map from raw scores to probabilities, linear between the pooled blocks."""

    at: np.ndarray
    to: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, y: np.ndarray) -> "Isotonic":
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum of y, sum of raw, rows
        # one prior row of either label keeps probabilities off 0 and 1
        for r, v in zip(raw[order], y[order]):
            blocks.append([float(v), float(r), 1.0])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                s = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], s)]
        s, r, n = np.array(blocks).T
        return cls(r / n, (s + 0.05) / (n + 0.1))

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        inner = np.interp(raw, self.at, self.to)
        # beyond the end blocks the raw score still orders rows
        low, high = self.to[0], self.to[-1]
        inner = np.where(raw < self.at[0], low * np.exp(np.clip(raw - self.at[0], -35, 0)), inner)
        return np.where(raw > self.at[-1], 1 - (1 - high) * np.exp(-np.clip(raw - self.at[-1], 0, 35)), inner)
