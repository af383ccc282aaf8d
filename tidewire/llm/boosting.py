"""Gradient-boosted trees for a few classes, fitted and applied in numpy.

Features are cut into at most ``BINS`` quantiles; a tree grows level by level
from histograms of gradients, one tree per class and round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Complete binary trees: node i has the children 2 i + 1 and 2 i + 2; leaves lie in the last level."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # go right if the value is greater
    leaf: np.ndarray  # (trees, leaves)
    classes: int
    prior: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log of each class's probability, by row."""
        out = np.tile(self.prior, (len(x), 1))
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        base = np.arange(len(x)) * width
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                node = 2 * node + 1 + (flat[base + self.feature[t][node]] > self.cut[t][node])
                if not len(node) or node[0] >= inner:
                    break
            out[:, t % self.classes] += self.leaf[t][node - inner]
        out -= out.max(axis=1, keepdims=True, initial=-np.inf) if len(out) else 0
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2, smooth: float = 2.0, weight: np.ndarray | None = None, sample: float = 0.5, seed: int = 1) -> Trees:
    """``sample`` of the rows, drawn anew for every round, grow its trees."""
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], axis=1)  # bin b: edges[b-1] < x <= edges[b]
    share = np.array([weight[y == c].sum() for c in range(classes)]) + smooth
    prior = np.log(share / share.sum())
    score = np.tile(prior, (n, 1))
    inner = (1 << depth) - 1
    feature, cut, leaf = [], [], []
    draw = np.random.default_rng(seed)
    wide = np.arange(width) * BINS
    usable = np.zeros((width, BINS), bool)  # bins that a cut may lie behind
    for j, e in enumerate(edges):
        usable[j, : len(e)] = True
    bounds = np.zeros((width, BINS))
    for j, e in enumerate(edges):
        bounds[j, : len(e)] = e
    for _ in range(rounds):
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        rows = np.flatnonzero(draw.random(n) < sample)
        keys = binned[rows] + wide
        step = np.zeros_like(score)
        for c in range(classes):
            g, h = ((y == c) - p[:, c])[rows] * weight[rows], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)[rows] * weight[rows]
            gg, hh = np.repeat(g, width), np.repeat(h, width)
            f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(rows), np.int64)
            for level in range(depth):
                first, size = (1 << level) - 1, 1 << level
                key = (keys + ((node - first) * (width * BINS))[:, None]).ravel()
                sg, sh = (np.bincount(key, v, size * width * BINS).reshape(size, width, BINS).cumsum(2) for v in (gg, hh))
                all_g, all_h = sg[:, :, -1:], sh[:, :, -1:]
                gain = np.where(usable, sg**2 / (sh + smooth) + (all_g - sg) ** 2 / (all_h - sh + smooth) - all_g**2 / (all_h + smooth), 0).reshape(size, -1)
                at = gain.argmax(1)
                split = gain[np.arange(size), at] > 1e-9
                f[first : first + size][split] = at[split] // BINS
                t[first : first + size][split] = bounds[at[split] // BINS, at[split] % BINS]
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            leaves = node - inner
            value = rate * np.bincount(leaves, g, inner + 1) / (np.bincount(leaves, h, inner + 1) + smooth)
            feature.append(f)
            cut.append(t)
            leaf.append(value)
            node = np.zeros(n, np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
            step[:, c] = value[node - inner]
        score += step
    return Trees(np.array(feature), np.array(cut), np.array(leaf), classes, prior)
