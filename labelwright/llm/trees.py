"""Histogram decision trees in numpy: gradient-boosted trees and a random forest, both kept as flat arrays.

A tree of depth d is a complete binary tree: inner node i has children 2i+1 (value <= threshold) and 2i+2; a node that is
not split sends every row left.  All trees of a model share arrays of shape (trees, nodes), so that scoring is d rounds
of fancy indexing over all rows and trees.
"""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, j], q)) if len(x) else np.zeros(0) for j in range(x.shape[1])]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], depth: int, bins: int, l2: float, least: float, rng: np.random.Generator | None = None, share: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree on gradients g and weights h (leaf value sum(g) / (sum(h) + l2)): features, thresholds, leaf values."""
    n, m = b.shape
    feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    node = np.zeros(n, np.int64)
    flat = b + np.arange(m) * bins
    for level in range(depth):
        k, base = 2**level, 2**level - 1
        at = ((node * (m * bins))[:, None] + flat).ravel()
        size = k * m * bins
        G = np.bincount(at, np.repeat(g, m), size).reshape(k, m, bins).cumsum(2)
        H = np.bincount(at, np.repeat(h, m), size).reshape(k, m, bins).cumsum(2)
        total_g, total_h = G[:, :1, -1:], H[:, :1, -1:]
        right_g, right_h = total_g - G, total_h - H
        gain = G**2 / (H + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
        gain[(H < least) | (right_h < least)] = -1
        if rng is not None and share < 1:
            drop = rng.random((k, m)).argsort(1) >= max(1, round(share * m))
            gain[drop] = -1
        best = gain.reshape(k, -1).argmax(1)
        good = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
        f, cut = best // bins, best % bins
        for i in np.flatnonzero(good):
            feature[base + i] = f[i]
            threshold[base + i] = edges[f[i]][cut[i]] if cut[i] < len(edges[f[i]]) else np.inf
        right = good[node] & (b[np.arange(n), f[node]] > cut[node])
        node = 2 * node + right
    leaf = np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
    return feature, threshold, leaf


class Trees:
    """feature, threshold: (trees, inner nodes); leaf: (trees, leaves)."""

    def __init__(self, grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int):
        self.depth = depth
        self.feature, self.threshold, self.leaf = (np.stack(a) for a in zip(*grown))

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees)"""
        out = np.empty((len(x), len(self.leaf)))
        tree = np.arange(len(self.leaf))
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            node = np.zeros((len(part), len(tree)), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[at : at + 8192] = self.leaf[tree, node - (2**self.depth - 1)]
        return out


class BoostedTrees:
    """Logistic gradient boosting on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 4.0):
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.trees = None
        if not len(y) or y.min() == y.max():
            return
        edges = bin_edges(x, bins)
        b, score, grown = binned(x, edges), np.full(len(y), self.base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            f, t, leaf = grow(b, y - p, p * (1 - p), edges, depth, bins, l2, least)
            grown.append((f, t, rate * leaf))
            score = score + Trees(grown[-1:], depth).values(x)[:, 0]
        self.trees = Trees(grown, depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if self.trees is not None and len(x):
            raw = raw + self.trees.values(x).sum(1)
        return 1 / (1 + np.exp(-raw))


class RandomForest:
    """Trees on bootstrap rows and random features of each node; the score is the mean leaf share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, bins: int = 32, seed: int = 7):
        self.base, self.trees = float((y.sum() + 1) / (len(y) + 2)), None
        if not len(y) or y.min() == y.max():
            return
        rng, edges = np.random.default_rng(seed), bin_edges(x, bins)
        b, grown = binned(x, edges), []
        share = min(1.0, max(2, np.sqrt(x.shape[1])) * 1.5 / x.shape[1])
        for _ in range(trees):
            take = rng.integers(0, len(y), len(y))
            grown.append(grow(b[take], y[take].astype(float), np.ones(len(take)), edges, depth, bins, 1e-9, 2.0, rng, share))
        self.trees = Trees(grown, depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.base)
        return np.clip(self.trees.values(x).mean(1), 0, 1)
