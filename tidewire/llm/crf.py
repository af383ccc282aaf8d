"""Two-label linear-chain conditional random fields in numpy.

A model scores a labelling y of a sequence by
``start[y0] + sum(trans[y(t-1), y(t)]) + sum(y(t) * x(t))`` where ``x`` is the
emission score of label 1 against label 0.  Sequences are given flat, with
offsets; they are padded in groups of similar length, so the loops run over
positions while numpy runs over sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per feature
    bias: float
    start: np.ndarray  # 2
    trans: np.ndarray  # 2 x 2, from, to

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias


def _groups(off: np.ndarray, most: int = 1 << 19):
    """Rows with like lengths together, and their cells: (index matrix, valid mask)."""
    lengths = np.diff(off)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        first = lengths[order[at]]
        to = int(np.searchsorted(lengths[order], max(first * 1.5, first + 8), "right"))
        while to > at + 1 and (to - at) * lengths[order[to - 1]] > most:
            to = at + max(1, (to - at) // 2)
        rows = order[at:to]
        width = int(lengths[rows[-1]])
        steps = np.arange(width)[:, None]
        yield rows, np.minimum(off[rows] + steps, off[rows + 1] - 1), steps < lengths[rows], lengths[rows]
        at = to


def marginals(x: np.ndarray, off: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: P(label 1) of each place, log Z of each sequence, and expected transitions (2 x 2)."""
    p, log_z, pairs = np.zeros(len(x)), np.zeros(len(off) - 1), np.zeros((2, 2))
    m = model.trans
    for rows, cells, ok, length in _groups(off):
        t, k = cells.shape
        e = x[cells]
        f = np.empty((t, 2, k))
        f[0, 0], f[0, 1] = model.start[0], model.start[1] + e[0]
        for i in range(1, t):
            a, b = f[i - 1]
            f[i, 0] = np.logaddexp(a + m[0, 0], b + m[1, 0])
            f[i, 1] = np.logaddexp(a + m[0, 1], b + m[1, 1]) + e[i]
        last = f[length - 1, :, np.arange(k)]
        z = np.logaddexp(last[:, 0], last[:, 1])
        log_z[rows] = z
        b = np.zeros((t, 2, k))
        for i in range(t - 2, -1, -1):
            to1 = b[i + 1, 1] + e[i + 1]
            more = ok[i + 1]
            b[i, 0] = np.where(more, np.logaddexp(m[0, 0] + b[i + 1, 0], m[0, 1] + to1), 0)
            b[i, 1] = np.where(more, np.logaddexp(m[1, 0] + b[i + 1, 0], m[1, 1] + to1), 0)
        p[cells[ok]] = np.exp(np.minimum(0, (f[:, 1] + b[:, 1] - z)[ok]))
        for u in (0, 1):
            for v in (0, 1):
                w = f[:-1, u] + m[u, v] + v * e[1:] + b[1:, v] - z
                pairs[u, v] += np.exp(np.minimum(0, w[ok[1:]])).sum()
    return p, log_z, pairs


def odds(x: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    """Forward-backward on likelihood ratios: P(label 1) of each place; the fast form of :func:`marginals`."""
    p = np.zeros(len(x))
    (a, b), (c, d) = np.exp(model.trans - model.trans[0, 0])
    s = np.exp(model.start[1] - model.start[0])
    for _, cells, ok, _ in _groups(off):
        e = np.exp(np.clip(x[cells], -60, 60))
        f, g = np.empty(e.shape), np.ones(e.shape)
        f[0] = s * e[0]
        for i in range(1, len(e)):
            r = f[i - 1]
            f[i] = e[i] * (b + r * d) / (a + r * c)
        for i in range(len(e) - 2, -1, -1):
            r = e[i + 1] * g[i + 1]
            g[i] = np.where(ok[i + 1], (c + r * d) / (a + r * b), 1)
        q = f * g
        p[cells[ok]] = (q / (1 + q))[ok]
    return p


def viterbi(x: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    """Labels of the best labelling; ties go to label 0."""
    out, m = np.zeros(len(x), np.int8), model.trans
    for _, cells, ok, length in _groups(off):
        t, k = cells.shape
        e = x[cells]
        v0, v1 = np.full(k, model.start[0]), model.start[1] + e[0]
        back = np.zeros((t, 2, k), np.int8)
        end = np.zeros(k, np.int8)
        end[length == 1] = (v1 > v0)[length == 1]
        for i in range(1, t):
            a, b = v0 + m[0, 0], v1 + m[1, 0]
            c, d = v0 + m[0, 1], v1 + m[1, 1]
            back[i, 0], back[i, 1] = b > a, d > c
            v0, v1 = np.maximum(a, b), np.maximum(c, d) + e[i]
            stop = length == i + 1
            end[stop] = (v1 > v0)[stop]
        y, lanes = np.zeros(k, np.int8), np.arange(k)
        for i in range(t - 1, -1, -1):
            y = np.where(length == i + 1, end, y).astype(np.int8)
            out[cells[i][ok[i]]] = y[ok[i]]
            if i:
                y = back[i, y, lanes]
    return out


def fit(features: np.ndarray, labels: np.ndarray, off: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam steps on standardised features; deterministic."""
    n, k = features.shape
    center, scale = features.mean(0), features.std(0) + 1e-6
    z = (features - center) / scale
    y = labels.astype(float)
    first = off[:-1][np.diff(off) > 0]
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), 1)
    begin = np.array([(labels[first] == v).sum() for v in (0, 1)], float)
    theta = np.zeros(k + 7)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)

    def model(p: np.ndarray) -> Model:
        return Model(p[:k], float(p[k]), p[k + 1 : k + 3], p[k + 3 :].reshape(2, 2))

    for step in range(1, rounds + 1):
        now = model(theta)
        p, _, pairs = marginals(now.emissions(z), off, now)
        g = np.concatenate([z.T @ (y - p), [(y - p).sum()], begin - np.array([(1 - p[first]).sum(), p[first].sum()]), (seen - pairs).ravel()]) / max(1, n) - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    done = model(theta)
    w = done.weights / scale
    return Model(w, float(done.bias - (w * center).sum()), done.start, done.trans)
