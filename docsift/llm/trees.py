"""Gradient-boosted trees on binned features, and isotonic calibration; plain numpy on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: A leaf holds one row in a hundred at least, and never fewer than LEAST_ROWS.
BINS, DEPTH, TREES, RATE, LEAST_ROWS, SHRINK = 64, 3, 80, 0.12, 5, 2.0


@dataclass
class Forest:
    """Complete trees of one depth: ``feature`` and ``cut`` by inner node, ``leaf`` by leaf."""

    start: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Logistic loss, second-order gains, histograms over quantile bins."""
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    forest = Forest(float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    raw, inner, least = np.full(len(x), forest.start), (1 << DEPTH) - 1, max(LEAST_ROWS, len(x) // 100)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * BINS + codes[:, f]
                sums = [np.cumsum(np.bincount(at, w, n * BINS).reshape(n, BINS), axis=1) for w in (g, h, np.ones(len(x)))]
                (gl, hl, nl), (ga, ha, na) = [s[:, : len(e)] for s in sums], [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + SHRINK) + (ga - gl) ** 2 / (ha - hl + SHRINK) - ga**2 / (ha + SHRINK)
                gain[(nl < least) | (na - nl < least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(n), k]
                better = top > best
                feature[first : first + n][better], cut[first : first + n][better], best[better] = f, e[k[better]], top[better]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = RATE * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + SHRINK)
        for k, v in (("feature", feature), ("cut", cut), ("leaf", leaf)):
            getattr(forest, k).append(v)
        raw += leaf[node - inner]
    return forest


@dataclass
class Isotonic:
    """A rising curve through the means of pooled neighbours; straight lines between them, so few scores are tied."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.at, self.value) if len(self.at) else np.full(len(raw), 0.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools adjacent violators."""
    blocks: list[list[float]] = []  # sum of labels, rows, sum of raw
    for r, v in sorted(zip(raw.tolist(), y.tolist(), strict=True)):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return Isotonic(b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]) if len(b) else Isotonic(np.zeros(0), np.zeros(0))
