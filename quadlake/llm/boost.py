"""Gradient-boosted trees with logistic loss over binned features, in numpy: fitted on the driver, read by the workers."""

from __future__ import annotations

import numpy as np

BINS = 16


class Boosted:
    """Trees of a fixed depth as arrays: at each inner node a feature and a threshold, at each leaf a value."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.rounds, inner), dtype=np.int64)
        self.threshold = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, inner + 1))
        margin = np.full(len(y), self.base)
        for r in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h, node = q - y, np.maximum(q * (1 - q), 1e-6), np.zeros(len(y), dtype=np.int64)
            for n in range(inner):
                at = np.flatnonzero(node == n)
                best = (1e-6, None, None)
                gain0 = g[at].sum() ** 2 / (h[at].sum() + self.ridge)
                for f, c in enumerate(cuts):
                    if not len(c) or not len(at):
                        continue
                    gl, hl = (np.cumsum(np.bincount(binned[at, f], weights=w[at], minlength=len(c) + 1))[:-1] for w in (g, h))
                    gain = gl**2 / (hl + self.ridge) + (g[at].sum() - gl) ** 2 / (h[at].sum() - hl + self.ridge) - gain0
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
                if best[1] is not None:
                    self.feature[r, n], self.threshold[r, n] = best[1], cuts[best[1]][best[2]]
                node[at] = 2 * n + 1 + (x[at, self.feature[r, n]] > self.threshold[r, n])
            for n in range(inner + 1):
                at = node == inner + n
                self.leaf[r, n] = -self.rate * g[at].sum() / (h[at].sum() + self.ridge)
            margin += self.leaf[r, node - inner]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, inner, rows = np.full(len(x), self.base), 2**self.depth - 1, np.arange(len(x))
        for r in range(self.rounds):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[r, node]] > self.threshold[r, node])
            out += self.leaf[r, node - inner]
        return out


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """a, b such that 1 / (1 + exp(-(a * margin + b))) is a calibrated probability; by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * margin).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        m = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)
