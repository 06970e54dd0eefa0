"""Gradient-boosted trees with logistic loss on dense features, and isotonic calibration; numpy only.

Trees are complete binary trees of a fixed depth, grown level by level on binned features, so that a whole batch is
scored by a few array operations per level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right where value > threshold
    leaf: np.ndarray  # trees x leaves
    base: float
    steps_x: np.ndarray = field(default_factory=lambda: np.array([0.0]))  # isotonic map: margin -> probability
    steps_y: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def margin(self, x: np.ndarray, step: int = 4096) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for first in range(0, len(x), step):  # a part of the rows stays in the cache for all trees
            part = np.ascontiguousarray(x[first : first + step])
            begin = np.arange(len(part)) * part.shape[1]
            flat, margin = part.ravel(), out[first : first + step]
            for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
                node = np.zeros(len(part), dtype=np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (flat.take(begin + feature.take(node)) > threshold.take(node))
                margin += leaf.take(node - (len(leaf) - 1))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(np.asarray(x, dtype=np.float64)), self.steps_x, self.steps_y)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing step function of the margin closest to the labels, as points to interpolate."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, sum of labels, number
    for m, label in zip(margin[order], y[order]):
        blocks.append([m, label, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # Laplace smoothing keeps the ends off 0 and 1
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0, seed: int = 1, held_out: float = 0.25, hold: np.ndarray | None = None) -> Boosted:
    """Fit on a share of the rows and calibrate on the held-out rest: those of hold, else a random share."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    if hold is None:
        hold = np.random.default_rng(seed).random(len(x)) < held_out
    xt, yt = x[~hold], y[~hold]
    n, width = xt.shape
    edges = []
    binned = np.zeros((n, width), dtype=np.int64)
    for j in range(width):
        values = np.unique(xt[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(xt[:, j], np.linspace(0, 1, bins + 1)))
        cut = (values[:-1] + values[1:]) / 2
        edges.append(cut)
        binned[:, j] = np.searchsorted(cut, xt[:, j], side="left")
    most = max((len(c) for c in edges), default=0) + 1
    rate0 = min(max(yt.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate0 / (1 - rate0)))
    f = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    model = Boosted(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    offset = np.arange(width) * most
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = yt - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (width * most) + offset[None, :] + binned).ravel()
            size = count * width * most
            gs = np.bincount(flat, np.repeat(g, width), size).reshape(count, width, most).cumsum(2)
            hs = np.bincount(flat, np.repeat(h, width), size).reshape(count, width, most).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least * 0.05) | (ht - hs < least * 0.05)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), most)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    model.feature[t, first + k], model.threshold[t, first + k] = j, edges[j][b]
            chosen = model.feature[t, node]
            node = 2 * node + 1 + (xt[np.arange(n), chosen] > model.threshold[t, node])
        at = node - inner
        value = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        model.leaf[t] = value
        f += value[at]
    if hold.any():
        model.steps_x, model.steps_y = isotonic(model.margin(x[hold]), y[hold])
    return model
