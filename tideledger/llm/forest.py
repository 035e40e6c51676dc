"""Histogram gradient-boosted trees for two classes, flattened for numpy traversal.

Training is for a bounded sample on the driver; prediction runs in Spark tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """All nodes of all trees in arrays; a leaf's children are itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """One step per level for all rows and trees together."""
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            rows = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            line = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = np.where(rows[line, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: int = 8) -> Forest:
    """Boosted trees on second-order logistic loss; splits on quantile bins of each feature."""
    n, width = x.shape
    base = float(np.clip(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)), -6, 6)) if n else 0.0
    roots, feature, threshold, left, right, value = [], [], [], [], [], []
    if n >= 2 * least and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
        bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)])
        offset = np.arange(width)[:, None] * BINS
        margin = np.full(n, base)
        for _ in range(trees):
            p = sigmoid(margin)
            grad, hess = p - y, p * (1 - p)
            roots.append(len(feature))
            waiting = [(np.arange(n), 0, len(feature))]
            for store, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
                store.append(v)
            while waiting:
                rows, level, at = waiting.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                value[at] = -rate * g / (h + l2)
                margin[rows] += value[at] if level == depth else 0
                if level < depth and len(rows) >= 2 * least:
                    flat = (bins[:, rows] + offset).ravel()
                    many = np.bincount(flat, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                    gs = np.bincount(flat, np.tile(grad[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(flat, np.tile(hess[rows], width), width * BINS).reshape(width, BINS).cumsum(1)
                    gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
                    gain[(many < least) | (len(rows) - many < least)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-3 and b < len(edges[f]):
                        feature[at], threshold[at] = int(f), float(edges[f][b])
                        below = bins[f, rows] <= b
                        for side, own in ((left, rows[below]), (right, rows[~below])):
                            side[at] = len(feature)
                            waiting.append((own, level + 1, len(feature)))
                            for store, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
                                store.append(v)
                        continue
                if level < depth:
                    margin[rows] += value[at]
        for k in range(len(feature)):  # leaves lead to themselves
            if left[k] == k:
                right[k] = k
    if not roots:
        roots, feature, threshold, left, right, value = [0], [0], [0.0], [0], [0], [0.0]
    leaf = np.array(left) == np.arange(len(left))
    return Forest(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.where(leaf, value, 0.0), depth, base)


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing map of scores to frequencies (pool adjacent violators), as points."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, lowest and highest score
    for s, v in zip(scores[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([1.0, float(v), s, s])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            w, m, _, high = blocks.pop()
            w0, m0, low, _ = blocks.pop()
            blocks.append([w + w0, (w * m + w0 * m0) / (w + w0), low, high])
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([(b[0] * b[1] + 0.25) / (b[0] + 0.5) for b in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys) if len(ys) else ys
