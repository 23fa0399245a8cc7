"""Gradient-boosted trees for binary labels in numpy: quantile bins, second-order splits, logistic loss."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Forest(NamedTuple):
    base: float
    feature: np.ndarray  # (trees, nodes); -1 at a leaf
    cut: np.ndarray
    value: np.ndarray
    depth: int


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 1.0, ridge: float = 1.0, share: float = 0.35, seed: int = 5) -> Forest:
    """Trees as implicit binary heaps; ``x`` below or at a cut goes to child ``2 i + 1``. Each tree sees a ``share`` of the rows."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    rng = np.random.default_rng(seed)
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    coded = coded + starts[:-1]
    score, nodes = np.full(len(y), base), 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, p * (1 - p)
        seen = [np.flatnonzero(rng.random(len(y)) < share)] + [None] * (nodes - 1)
        for node in range(nodes):
            rows = seen[node]
            if rows is None or not len(rows):
                continue
            g, h = gradient[rows].sum(), hessian[rows].sum()
            value[t, node] = rate * g / (h + ridge)
            if 2 * node + 2 >= nodes or h <= 2 * least:
                continue
            flat = coded[rows].ravel()
            sums = [np.bincount(flat, np.repeat(v[rows], len(cuts)), starts[-1]) for v in (gradient, hessian)]
            left_g, left_h = (np.concatenate([np.cumsum(v[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]) for v in sums)
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            gain[(left_h < least) | (h - left_h < least)] = -1
            gain[starts[1:] - 1] = -1  # all rows on one side
            k = int(gain.argmax())
            if gain[k] <= 1e-6:
                continue
            f = int(np.searchsorted(starts, k, side="right")) - 1
            feature[t, node], cut[t, node] = f, cuts[f][k - starts[f]]
            low = coded[rows, f] <= k
            seen[2 * node + 1], seen[2 * node + 2] = rows[low], rows[~low]
        score = score + _one(feature[t], cut[t], value[t], depth, x)
    return Forest(base, feature, cut, value, depth)


def _one(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, depth: int, x: np.ndarray) -> np.ndarray:
    rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = feature[at]
        at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]))
    return value[at]


def predict(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Log odds of label 1."""
    out = np.full(len(x), forest.base)
    for feature, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
        out += _one(feature, cut, value, forest.depth, x)
    return out
