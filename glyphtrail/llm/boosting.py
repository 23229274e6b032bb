"""Small gradient-boosted trees and isotonic calibration in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over binned dense features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [self._edges(c) for c in x.T]
        binned = self._bin(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = np.full(len(y), self.base)
        for _ in range(self.trees if len(y) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.nodes.append(tree)
            raw += self._walk(tree, binned)
        return self

    def _edges(self, c: np.ndarray) -> np.ndarray:
        """Quantiles of the rows, and of the middles between distinct values, so that rare values
        are parted from a common one too."""
        if not len(c):
            return np.zeros(0)
        values, at = np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1]
        between = (values[:-1] + values[1:]) / 2
        return np.unique(np.concatenate([np.quantile(c, at), np.quantile(between, at), between[:1]])) if len(between) else values

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        """A full tree by levels: node i has children 2i + 1 and 2i + 2; feature -1 is a leaf."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(grad), int)
        for node in range(size):
            here = np.flatnonzero(at == node)
            g, h = grad[here].sum(), hess[here].sum()
            value[node] = self.rate * g / (h + self.ridge)
            if node >= 2**self.depth - 1 or len(here) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for f in range(binned.shape[1]):
                b = binned[here, f]
                n = len(self.edges[f]) + 1
                gl, hl = np.cumsum(np.bincount(b, grad[here], n))[:-1], np.cumsum(np.bincount(b, hess[here], n))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=n))[:-1]
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(nl < self.least) | (len(here) - nl < self.least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                right = binned[here, best[1]] > best[2]
                at[here] = 2 * node + 1 + right
        return feature, cut, value

    def _walk(self, tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(binned), int)
        for _ in range(self.depth):
            f = feature[at]
            right = binned[np.arange(len(binned)), np.maximum(f, 0)] > cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        out = np.full(len(x), self.base)
        for t in self.nodes:
            out += self._walk(t, binned)
        return out


class Isotonic:
    """Pool-adjacent-violators fit of a non-decreasing map from raw score to probability;
    a prior of one half row each way keeps it off 0 and 1, steps are joined by lines."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []  # sum of y, rows, sum of raw
        for r, v in zip(raw[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(r)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[2] / b[1] for b in blocks] or [0.0])
        self.p = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks] or [0.5])
        self.p = np.maximum.accumulate(self.p)
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.p)
