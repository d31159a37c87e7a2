"""Gradient-boosted trees in NumPy: fitted on a bounded sample, scored over flat node arrays.

The trees are grown level by level on binned features. A feature may be bound to
be non-decreasing (1) or non-increasing (-1): a split against the direction is
refused, and a split's children get the middle of its values as a bound that
their whole subtrees keep, so the score is monotonic over the full range.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature while trees are grown.
BINS = 64
#: Regularisation of a leaf: added to its sum of second derivatives.
RIDGE = 1.0


@dataclass(frozen=True)
class Trees:
    """All trees as arrays with one entry per node; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row of ``x``; a missing value goes left."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.cut[node]
                node = np.where(right, self.right[node], self.left[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 20) -> Trees:
    """Trees for 0/1 labels ``y`` by second-order boosting of the logistic loss.

    ``least`` is the number of rows a leaf holds at least. Without rows of both
    labels no tree is grown and the score is the (smoothed) share of ones.
    """
    x = np.nan_to_num(np.asarray(x, np.float64))
    y = np.asarray(y, np.float64)
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (len(y) - ones + 0.5)))
    columns: dict[str, list] = {name: [] for name in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []
    if 0 < ones < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
        margin = np.full(len(y), base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(columns["value"]))
            margin += _grow(columns, binned, edges, p - y, p * (1 - p), monotone, depth, rate, least)
    arrays = {name: np.array(values, np.float64 if name in ("cut", "value") else np.int64) for name, values in columns.items()}
    return Trees(**arrays, roots=np.array(roots, np.int64), base=base, depth=depth)


def _leaf(g: float, h: float, low: float, high: float) -> float:
    return min(max(-g / (h + RIDGE), low), high)


def _grow(columns, binned, edges, g, h, monotone, depth, rate, least) -> np.ndarray:
    """Append one tree to ``columns``; returns what it adds to every row's margin."""
    added = np.zeros(len(g))

    def node(value: float) -> int:
        here = len(columns["value"])
        for name, entry in (("feature", 0), ("cut", np.inf), ("left", here), ("right", here), ("value", rate * value)):
            columns[name].append(entry)
        return here

    def split(rows: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = _leaf(total_g, total_h, low, high)
        here = node(value)
        best = None
        if level < depth and len(rows) >= 2 * least:
            parent = _gain(total_g, total_h, value)
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                own, size = binned[rows, f], len(cuts) + 1
                lg = np.cumsum(np.bincount(own, g[rows], size))[:-1]
                lh = np.cumsum(np.bincount(own, h[rows], size))[:-1]
                ln = np.cumsum(np.bincount(own, minlength=size))[:-1]
                lv = np.clip(-lg / (lh + RIDGE), low, high)
                rv = np.clip(-(total_g - lg) / (total_h - lh + RIDGE), low, high)
                gain = _gain(lg, lh, lv) + _gain(total_g - lg, total_h - lh, rv) - parent
                allowed = (ln >= least) & (len(rows) - ln >= least) & (monotone[f] * (rv - lv) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = (gain[at], f, at, lv[at], rv[at])
        if best is None:
            added[rows] = rate * value
            return here
        _, f, at, lv, rv = best
        middle = (lv + rv) / 2
        sides = [(low, high), (low, high)]
        if monotone[f] > 0:
            sides = [(low, middle), (middle, high)]
        elif monotone[f] < 0:
            sides = [(middle, high), (low, middle)]
        goes_left = binned[rows, f] <= at
        columns["feature"][here], columns["cut"][here] = f, edges[f][at]
        columns["left"][here] = split(rows[goes_left], level + 1, *sides[0])
        columns["right"][here] = split(rows[~goes_left], level + 1, *sides[1])
        return here

    split(np.arange(len(g)), 0, -np.inf, np.inf)
    return added


def _gain(g, h, value):
    """What a leaf of this value takes off the loss (second order)."""
    return -(g * value + 0.5 * (h + RIDGE) * value * value)


def calibrated_cut(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Smallest score at which the rows from there on hold at least ``precision`` ones.

    Above 1 (nothing is selected) if no such score exists.
    """
    order = np.argsort(-probability, kind="stable")
    ranked, hits = probability[order], np.cumsum(y[order])
    last = np.r_[ranked[1:] != ranked[:-1], True] if len(ranked) else np.empty(0, bool)
    good = last & (hits >= precision * np.arange(1, len(ranked) + 1))
    return float(ranked[good].min()) if good.any() else 2.0
