"""Gradient-boosted trees with isotonic calibration, fitted with numpy on a bounded sample.

A model is a few hundred numbers.  It scores arrays, or becomes one SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # inner nodes, level by level
    threshold: np.ndarray  # a value above it goes right
    leaf: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    base: float = -4.0
    trees: list[Tree] = field(default_factory=list)
    curve: tuple[np.ndarray, np.ndarray] | None = None  # margin -> calibrated probability

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(len(tree.leaf).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, tree.feature[at]] > tree.threshold[at])
            out += tree.leaf[at - len(tree.feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.margin(x)
        return np.interp(margin, *self.curve) if self.curve is not None else _sigmoid(margin)

    def margin_sql(self, names: list[str]) -> str:
        """The margin as a SQL expression over the named numeric columns."""

        def node(tree: Tree, at: int) -> str:
            inner = len(tree.feature)
            if at >= inner:
                return f"{float(tree.leaf[at - inner])!r}D"
            if not np.isfinite(tree.threshold[at]):
                return node(tree, 2 * at + 1)
            left, right = node(tree, 2 * at + 1), node(tree, 2 * at + 2)
            if left == right:
                return left
            return f"IF({names[tree.feature[at]]} > {float(tree.threshold[at])!r}D, {right}, {left})"

        return " + ".join([f"{float(self.base)!r}D", *(f"({node(t, 0)})" for t in self.trees)])

    def margin_for(self, probability: float) -> float:
        """The least margin whose calibrated probability is at least this."""
        if self.curve is None:
            return float(np.log(probability / (1 - probability)))
        xs, ys = self.curve
        over = np.flatnonzero(ys >= probability)
        if not len(over):
            return float("inf")
        i = int(over[0])
        if i == 0 or ys[i] == ys[i - 1]:
            return float(xs[i])
        return float(xs[i - 1] + (xs[i] - xs[i - 1]) * (probability - ys[i - 1]) / (ys[i] - ys[i - 1]))


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> Tree:
    n, width = bins.shape[1], max(len(e) for e in edges) + 1
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(bins), np.int64)
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        local = node - first
        gain, best_f, best_b = np.full(count, 1e-6), np.zeros(count, np.int64), np.full(count, -1)
        for f in range(n):
            cell = local * width + bins[:, f]
            sg = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)
            sh = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)
            tg, th = sg[:, -1:], sh[:, -1:]
            value = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
            value[(sh < 1) | (th - sh < 1)] = -1
            value[:, len(edges[f]) :] = -1
            at = value.argmax(1)
            top = value[np.arange(count), at]
            better = top > gain
            gain[better], best_f[better], best_b[better] = top[better], f, at[better]
        for k in np.flatnonzero(best_b >= 0):
            feature[first + k], threshold[first + k] = best_f[k], edges[best_f[k]][best_b[k]]
        go = (best_b[local] >= 0) & (bins[np.arange(len(bins)), best_f[local]] > best_b[local])
        node = 2 * node + 1 + go
    local = node - inner
    leaf = -rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + 1)
    return Tree(feature, threshold, leaf)


def _boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float) -> Boosted:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 49)[1:-1])) for f in range(x.shape[1])]
    for f in range(x.shape[1]):  # rare events: quantiles may all be zero, so keep the positive range too
        over = x[x[:, f] > edges[f][-1], f]
        edges[f] = np.unique(np.concatenate([edges[f], np.quantile(over, np.linspace(0, 1, 17)[:-1]) if len(over) else []]))
    # cut between values, not on them
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        up = values[np.minimum(np.searchsorted(values, edges[f], "right"), len(values) - 1)]
        edges[f] = np.unique((edges[f] + up) / 2)
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], 1)
    rate_of = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(rate_of / (1 - rate_of))))
    margin = np.full(len(x), model.base)
    for _ in range(trees):
        p = _sigmoid(margin)
        tree = _grow(bins, edges, p - y, p * (1 - p), depth, rate)
        model.trees.append(tree)
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, tree.feature[at]] > tree.threshold[at])
        margin += tree.leaf[at - len(tree.feature)]
    return model


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the middle of each pool and its mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, least x, greatest x
    for xi, yi in zip(x[order].tolist(), y[order].tolist()):
        pools.append([yi, 1, xi, xi])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, top = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = top
    xs, ys = [], []
    for s, n, low, high in pools:
        xs += [low] if low == high else [low, high]
        ys += [s / n] if low == high else [s / n] * 2
    return np.array(xs), np.array(ys)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, folds: int = 3) -> Boosted:
    """Trees on all rows; calibration on margins of rows that the trees of their fold haven't seen.

    Without rows of both classes the score is the share of class 1, or 0 without rows.
    """
    if len(y) < 8 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Boosted(0.0, [], (np.array([0.0]), np.array([share])))
    fold = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        train, rest = fold != k, fold == k
        out[rest] = (
            _boost(x[train], y[train], trees, depth, rate).margin(x[rest])
            if y[train].min() != y[train].max()
            else Boosted(0.0).margin(x[rest])
        )
    model = _boost(x, y, trees, depth, rate)
    model.curve = isotonic(out, y)
    return model
