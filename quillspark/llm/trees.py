"""Bagged decision trees on a bounded sample, small enough to go to every task."""

from __future__ import annotations

import numpy as np

DEPTH, LEAST_ROWS, BINS = 7, 4, 48


def _grow(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, edges: list[np.ndarray], depth: int, nodes: list[list[float]]) -> int:
    """Append the subtree of ``rows`` to ``nodes`` (feature, threshold, left, right, value); returns its position."""
    at = len(nodes)
    total = weight[rows].sum()
    mean = float((weight[rows] * y[rows]).sum() / total)
    nodes.append([-1, 0.0, -1, -1, mean])
    if depth == 0 or len(rows) < 2 * LEAST_ROWS or mean in (0.0, 1.0):
        return at
    best = (1e-9, -1, 0)
    for f, cuts in enumerate(edges):
        if len(cuts) == 0:
            continue
        n = np.bincount(codes[rows, f], weights=weight[rows], minlength=len(cuts) + 1).cumsum()[:-1]
        s = np.bincount(codes[rows, f], weights=weight[rows] * y[rows], minlength=len(cuts) + 1).cumsum()[:-1]
        left, right = s / np.maximum(n, 1e-12), (mean * total - s) / np.maximum(total - n, 1e-12)
        gain = np.where((n > 0) & (n < total), n * left**2 + (total - n) * right**2 - total * mean**2, -1.0) / total
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return at
    goes = codes[rows, best[1]] <= best[2]
    if goes.sum() < LEAST_ROWS or (~goes).sum() < LEAST_ROWS:
        return at
    nodes[at][0], nodes[at][1] = best[1], float(edges[best[1]][best[2]])
    nodes[at][2] = _grow(codes, y, weight, rows[goes], edges, depth - 1, nodes)
    nodes[at][3] = _grow(codes, y, weight, rows[~goes], edges, depth - 1, nodes)
    return at


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds for one feature: up to BINS, each in the middle of the gap above a quantile, so that a gap between two
    classes is cut in its middle."""
    values = np.unique(values)
    at = np.arange(len(values) - 1)
    if len(at) > BINS:
        gaps = np.argsort(values[:-1] - values[1:], kind="stable")[: BINS // 4]
        at = np.union1d(np.linspace(0, len(values) - 2, BINS).astype(int), gaps)
    return (values[at + 1] + values[at]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 15, seed: int = 0, share: float = 1.0) -> list[np.ndarray]:
    """Each tree is grown on rows drawn with replacement, and on this share of the features; the classes weigh the same
    in all."""
    random = np.random.default_rng(seed)
    edges = [_cuts(x[:, f]) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cuts, x[:, f], side="left") for f, cuts in enumerate(edges)], axis=1)
    ones = max(1e-9, float(y.mean()))
    weight = np.where(y > 0, 0.5 / ones, 0.5 / max(1e-9, 1 - ones))
    none = np.zeros(0)
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []
        seen = set(random.permutation(x.shape[1])[: max(1, round(share * x.shape[1]))].tolist())
        _grow(codes, y, weight, random.integers(0, len(y), len(y)), [e if f in seen else none for f, e in enumerate(edges)], DEPTH, nodes)
        out.append(np.array(nodes))
    return out


def predict(trees: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The mean of the trees' leaf values."""
    total = np.zeros(len(x))
    for nodes in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH + 1):
            feature = nodes[at, 0].astype(np.int64)
            inner = feature >= 0
            if not inner.any():
                break
            value = x[np.arange(len(x)), np.maximum(feature, 0)]
            child = np.where(value <= nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(np.int64)
            at = np.where(inner, child, at)
        total += nodes[at, 4]
    return total / max(1, len(trees))
