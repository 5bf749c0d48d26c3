"""Gradient-boosted trees over a bounded table of binned features, and their form as a column expression.

Rows with the same bins are one cell with a weight of positives and negatives, so training sees all data as a table no
larger than the product of the bins, whatever the input's size. Trees are scored on the JVM as nested CASE expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Trees as nested tuples (feature, bound, left, right) or leaf values; left is taken at or below the bound."""

    features: list[str]
    base: float = 0.0
    trees: list = field(default_factory=list)
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of binned features."""
        return 1 / (1 + np.exp(-(self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x))))))

    def column(self, get) -> Column:
        """The probability as a column; ``get`` gives a feature's column by name."""
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + self._column(tree, get)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def _column(self, tree, get) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, bound, left, right = tree
        return F.when(get(self.features[f]) <= int(bound), self._column(left, get)).otherwise(self._column(right, get))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, left, right = tree
    return np.where(x[:, f] <= bound, _apply(left, x), _apply(right, x))


def _grow(x, g, h, depth, rate, penalty):
    leaf = -rate * g.sum() / (h.sum() + penalty)
    if depth == 0 or len(x) < 2:
        return leaf
    best, cut = 1e-9, None
    whole = g.sum() ** 2 / (h.sum() + penalty)
    for f in range(x.shape[1]):
        values, at = np.unique(x[:, f], return_inverse=True)
        gs, hs = np.bincount(at, g), np.bincount(at, h)
        gl, hl = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
        gain = gl**2 / (hl + penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + penalty) - whole
        if len(gain) and gain.max() > best:
            best, cut = gain.max(), (f, int(values[gain.argmax()]))
    if cut is None:
        return leaf
    left = x[:, cut[0]] <= cut[1]
    return (*cut, _grow(x[left], g[left], h[left], depth - 1, rate, penalty), _grow(x[~left], g[~left], h[~left], depth - 1, rate, penalty))


def fit(features: list[str], x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 1.0) -> Boosted:
    """Logistic boosting with second-order leaves; without both classes the model scores the one it has and adds nothing."""
    model = Boosted(features)
    if not len(x) or not pos.sum() or not neg.sum():
        return model
    model.base = float(np.log(pos.sum() / neg.sum()))
    raw = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, (pos + neg) * p - pos, (pos + neg) * p * (1 - p), depth, rate, penalty)
        model.trees.append(tree)
        raw += _apply(tree, x)
    return model


def calibrate(model: Boosted, x: np.ndarray, pos: np.ndarray, neg: np.ndarray, precision: float, labelled: float = 1.0) -> None:
    """Set the lowest threshold at which the rows at or over it hold at least this share of positives (over 1 if none does).

    ``labelled``: the share of positives that are known as such; where it is below 1, a cell's positives are estimated as its
    known ones over that share, and no more than its rows.
    """
    model.threshold = 2.0
    if model.trees and labelled > 0:
        p = np.round(model.score(x), 9)
        true = np.minimum(pos / labelled, pos + neg)
        for t in np.unique(p)[::-1]:
            over = p >= t
            if pos[over].sum() and true[over].sum() >= precision * (pos[over].sum() + neg[over].sum()):
                model.threshold = float(t)


def labelled_share(model: Boosted, x: np.ndarray, pos: np.ndarray, least: float = 0.3) -> float:
    """Which share of positives is known: the lower quartile of known positives' scores (bins where all are known say nothing of the others), ``least`` at least."""
    if not pos.sum() or not model.trees:
        return 0.0
    score = model.score(x)
    order = np.argsort(score)
    return max(least, float(score[order][np.searchsorted(np.cumsum(pos[order]), 0.25 * pos.sum())]))


def to_json(models: dict[str, Boosted]) -> str:
    """Models as text, to train once and apply elsewhere."""
    return json.dumps({k: [m.features, m.base, m.trees, m.threshold] for k, m in models.items()})


def from_json(text: str) -> dict[str, Boosted]:
    """The models that ``to_json`` wrote."""

    def tree(t):
        return (t[0], t[1], tree(t[2]), tree(t[3])) if isinstance(t, list) else t

    return {k: Boosted(f, base, [tree(t) for t in trees], threshold) for k, (f, base, trees, threshold) in json.loads(text).items()}
