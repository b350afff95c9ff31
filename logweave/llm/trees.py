"""Histogram gradient-boosted trees for two classes, flattened into arrays.

Values are binned by quantiles once; a tree grows level by level from histograms of gradients over bins.
A constraint on a feature keeps the score from falling (1) or rising (-1) with it: splits against it are
refused, and the middle of a split bounds what may follow below. All trees lie in flat arrays, so a batch
walks down all of them in as many array operations as trees have levels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees: a leaf is its own child, so every walk can go on for ``depth`` steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of every row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0, monotone: dict[int, int] | None = None) -> Forest:
    """Boosted trees for labels ``y`` (0 or 1) of the rows of ``x``; one class or no row gives a constant."""
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) >= 2 * least and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        score = np.full(len(y), base)
        sign = np.array([(monotone or {}).get(f, 0) for f in range(x.shape[1])])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            score += _grow(binned, cuts, p - y, p * (1 - p), sign, nodes, roots, bins, depth, rate, least, ridge)
    if not roots:
        roots, nodes = [0], [[0, 0.0, 0, 0, 0.0]]
    columns = list(zip(*nodes, strict=True))
    whole = [np.array(columns[i], np.int64) for i in (0, 2, 3)]
    return Forest(np.array(roots), whole[0], np.array(columns[1], float), whole[1], whole[2], np.array(columns[4], float), depth, base)


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, sign: np.ndarray, nodes: list, roots: list, bins: int, depth: int, rate: float, least: int, ridge: float) -> np.ndarray:
    """Append one tree to ``nodes``; gives what it adds to the score of every row."""
    add = np.zeros(len(g))
    roots.append(len(nodes))
    nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
    level = [(roots[-1], np.arange(len(g)), -np.inf, np.inf)]
    for step in range(depth + 1):
        below = []
        for node, rows, low, high in level:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            weight = float(np.clip(-total_g / (total_h + ridge), low, high))
            best = None if step == depth or len(rows) < 2 * least else _split(binned, g, h, rows, total_g, total_h, sign, low, high, bins, least, ridge)
            if best is None:
                nodes[node][4] = rate * weight
                add[rows] += rate * weight
                continue
            f, b, w_left, w_right = best
            goes = binned[f, rows] <= b
            a, c = len(nodes), len(nodes) + 1
            for child in (a, c):
                nodes.append([0, 0.0, child, child, 0.0])
            nodes[node][:4] = [f, float(cuts[f][b]), a, c]
            middle = (w_left + w_right) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign[f])]
            below += [(a, rows[goes], *bounds[0]), (c, rows[~goes], *bounds[1])]
        level = below
    return add


def _split(binned, g, h, rows, total_g, total_h, sign, low, high, bins, least, ridge):
    """(feature, bin, left weight, right weight) of the best allowed split, or None."""
    own = total_g**2 / (total_h + ridge)
    best, found = 1e-6, None
    for f in range(len(binned)):
        code = binned[f, rows]
        n = np.cumsum(np.bincount(code, minlength=bins))[:-1]
        left_g = np.cumsum(np.bincount(code, g[rows], minlength=bins))[:-1]
        left_h = np.cumsum(np.bincount(code, h[rows], minlength=bins))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        w_left, w_right = np.clip(-left_g / (left_h + ridge), low, high), np.clip(-right_g / (right_h + ridge), low, high)
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - own
        allowed = (n >= least) & (len(rows) - n >= least) & (sign[f] * (w_right - w_left) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        b = int(gain.argmax())
        if gain[b] > best:
            best, found = float(gain[b]), (f, b, float(w_left[b]), float(w_right[b]))
    return found
