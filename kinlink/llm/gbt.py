"""Gradient-boosted trees and isotonic calibration in numpy, for training sets of bounded size."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary log-loss boosting of depth-limited trees over quantile bins. Rows are few by contract of the callers
    (a documented bound), so training fits in one process; prediction is vectorised and goes to executors."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, f = x.shape
        w = np.ones(n) if weight is None else weight
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
        code = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1) if n else np.zeros((0, f), int)
        mean = float(np.clip((w @ y + 0.5) / (w.sum() + 1), 1e-4, 1 - 1e-4))
        self.bias = float(np.log(mean / (1 - mean)))
        if n == 0 or y.min() == y.max():
            return self
        score = np.full(n, self.bias)
        flat = code + np.arange(f) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            feature = np.full(2 ** (self.depth + 1) - 1, -1)
            cut = np.zeros(len(feature), int)
            value = np.zeros(len(feature))
            node = np.zeros(n, int)
            for level in range(self.depth):
                for v in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == v)
                    if len(rows) < 2:
                        continue
                    at = flat[rows].ravel()
                    gs = np.bincount(at, np.repeat(g[rows], f), f * self.bins).reshape(f, self.bins).cumsum(1)
                    hs = np.bincount(at, np.repeat(h[rows], f), f * self.bins).reshape(f, self.bins).cumsum(1)
                    gt, ht = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > 1e-6:
                        feature[v], cut[v] = j, b
                        node[rows] = 2 * v + 1 + (code[rows, j] > b)
            leaf_g, leaf_h = np.bincount(node, g, len(value)), np.bincount(node, h, len(value))
            value = self.rate * leaf_g / (leaf_h + self.l2)
            self.trees.append((feature, cut, value))
            score += value[node]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        if not self.trees or not len(x):
            return score
        code = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[node]
                node = np.where(j < 0, node, 2 * node + 1 + (code[rows, np.maximum(j, 0)] > cut[node]))
            score += value[node]
        return score


class Isotonic:
    """Pool adjacent violators; values between two known scores are interpolated. smooth: pseudo rows of each label per pool."""

    def fit(self, score: np.ndarray, y: np.ndarray, smooth: float = 0.5) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # weight, positives, lowest and highest score
        for s, t in zip(score[order].tolist(), y[order].tolist(), strict=True):
            if pools and pools[-1][3] == s:
                pools[-1][0] += 1
                pools[-1][1] += t
            else:
                pools.append([1.0, t, s, s])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                w, p, _, hi = pools.pop()
                pools[-1][0] += w
                pools[-1][1] += p
                pools[-1][3] = hi
        prior = float(y.mean()) if len(y) else 0.5
        at, to = [], []
        for w, p, lo, hi in pools:
            v = (p + 2 * smooth * prior) / (w + 2 * smooth)
            at += [lo, hi] if hi > lo else [lo]
            to += [v, v] if hi > lo else [v]
        self.at, self.to = np.array(at or [0.0]), np.maximum.accumulate(np.array(to or [prior]))
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(score, self.at, self.to), 0, 1)


def calibrated(x: np.ndarray, y: np.ndarray, folds: np.ndarray, weight: np.ndarray | None = None, **kwargs) -> tuple[Boosted, Isotonic]:
    """Trees on all rows; the calibration from scores of rows left out, by fold."""
    out = np.zeros(len(y))
    for k in np.unique(folds):
        held = folds == k
        fold = Boosted(**kwargs).fit(x[~held], y[~held], None if weight is None else weight[~held])
        out[held] = fold.decision(x[held])
    return Boosted(**kwargs).fit(x, y, weight), Isotonic().fit(out, y)
