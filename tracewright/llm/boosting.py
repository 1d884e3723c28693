"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays: node k splits feature[k] at threshold[k] (<= goes left) or is a leaf (feature -1)."""

    base: float
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def arrays(self):
        return (np.array(self.feature, dtype=np.int32), np.array(self.threshold), np.array(self.left, dtype=np.int32), np.array(self.right, dtype=np.int32), np.array(self.value))

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Scores of all rows, every tree level by level without a loop over rows."""
        out = np.full(len(x), self.base)
        if not self.roots or not len(x):
            return out
        feature, threshold, left, right, value = self.arrays()
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, dtype=np.int32)
            while (inner := feature[node] >= 0).any():
                f = np.maximum(feature[node], 0)
                node = np.where(inner, np.where(x[rows, f] <= threshold[node], left[node], right[node]), node)
            out += value[node]
        return out


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 3.0) -> Forest:
    """monotone: feature -> +1 (score may only rise with it) or -1 (only fall).

    A split that breaks the constraint is not taken, and both sides are then bounded by the split's midpoint, so
    the whole tree is monotone. Without both classes the forest is its base rate alone.
    """
    monotone = monotone or {}
    rate_of = (y.sum() + 0.5) / (len(y) + 1.0)
    forest = Forest(base=float(np.log(rate_of / (1 - rate_of))))
    if len(y) < 2 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    scores = np.full(len(y), forest.base)

    def node() -> int:
        for part, empty in ((forest.feature, -1), (forest.threshold, 0.0), (forest.left, -1), (forest.right, -1), (forest.value, 0.0)):
            part.append(empty)
        return len(forest.feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = node()
        best = float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
        found = None
        if level:
            total_g, total_h, gain = g[rows].sum(), h[rows].sum(), 1e-6
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(codes[rows, j], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(codes[rows, j], h[rows], len(e) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                worth = (gl * vl - (hl + ridge) * vl**2 / 2) + (gr * vr - (hr + ridge) * vr**2 / 2) - (total_g * best - (total_h + ridge) * best**2 / 2)
                ok = (hl >= least) & (hr >= least)
                if sign := monotone.get(j, 0):
                    ok &= sign * (vr - vl) >= 0
                worth = np.where(ok, worth, -np.inf)
                k = int(np.argmax(worth))
                if worth[k] > gain:
                    gain, found = worth[k], (j, k, vl[k], vr[k])
        if found is None:
            forest.value[at] = rate * best
            scores[rows] += rate * best
            return at
        j, k, vl, vr = found
        middle = (vl + vr) / 2
        sign = monotone.get(j, 0)
        bounds = ((low, high), (low, high)) if not sign else ((low, middle), (middle, high)) if sign > 0 else ((middle, high), (low, middle))
        side = codes[rows, j] <= k
        forest.feature[at], forest.threshold[at] = j, float(edges[j][k])
        forest.left[at] = grow(rows[side], g, h, level - 1, *bounds[0])
        forest.right[at] = grow(rows[~side], g, h, level - 1, *bounds[1])
        return at

    for _ in range(trees):
        p = sigmoid(scores)
        forest.roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth, -4.0, 4.0))
    return forest


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100):
    """(centre, scale, weights, bias) of a ridge logistic regression by Newton steps on standardised columns.

    A step is halved until it lowers the loss: where the classes lie apart, whole steps go past the minimum and swing.
    """
    centre, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - centre) / scale, -8, 8)
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    w = np.zeros(z.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3

    def loss(w):
        return np.logaddexp(0, z @ w).sum() - y @ (z @ w) + penalty @ w**2 / 2

    now = loss(w)
    for _ in range(rounds if len(y) > 1 and y.min() != y.max() else 0):
        p = sigmoid(z @ w)
        rise = z.T @ (y - p) - penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), rise)
        part = 1.0
        while part > 1e-9 and not (then := loss(w + part * step)) <= now - 1e-4 * part * (rise @ step):
            part /= 2
        if part <= 1e-9:  # as low as floating point tells
            break
        w, now = w + part * step, then
        if np.abs(part * step).max() < 1e-6:
            break
    return centre, scale, w[:-1], float(w[-1])
