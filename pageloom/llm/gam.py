"""A generalised additive model with pairwise interactions, in numpy.

Cyclic boosting fits one shallow tree at a time to one feature (or one pair of features)
and adds it to that feature's lookup table over bins. Scoring is bin lookup and addition.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: int = 4

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row; a value that isn't finite falls in the last bin."""
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        total = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[bins[i] // self.coarse, bins[j] // self.coarse]
        return sigmoid(total)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The step of each bin: a tree of so many leaves over ordered bins, grown at the best split, each leaf a Newton step."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = np.arange(a + 1, b)
            if not len(k):
                continue
            hl, hr = ch[k] - ch[a], ch[b] - ch[k]
            gain = (cg[k] - cg[a]) ** 2 / (hl + 1) + (cg[b] - cg[k]) ** 2 / (hr + 1) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
            gain[(hl < least) | (hr < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), int(k[gain.argmax()]))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 200, rate: float = 0.1, leaves: int = 3, pairs: int = 6, coarse: int = 4, least: float = 2.0) -> Model:
    """Fit to rows of features and labels 0 and 1. Without rows, or with one label only, the score is constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="higher")) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share))), coarse=coarse)
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for b, t in zip(at, model.tables, strict=True):
            p = sigmoid(total)
            step = rate * shallow_tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), leaves, least)
            t += step
            total += step[b]
    wide = [len(t) // coarse + 1 for t in model.tables]
    p = sigmoid(total)

    def cells(i: int, j: int) -> np.ndarray:
        return at[i] // coarse * wide[j] + at[j] // coarse

    def gain(i: int, j: int) -> float:
        c = cells(i, j)
        g, h = np.bincount(c, y - p), np.bincount(c, p * (1 - p))
        return float((g**2 / (h + 1)).sum())

    model.pairs = sorted(combinations(range(len(at)), 2), key=lambda ij: -gain(*ij))[:pairs]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            p = sigmoid(total)
            c = cells(i, j)
            g, h = np.bincount(c, y - p, t.size).reshape(t.shape), np.bincount(c, p * (1 - p), t.size).reshape(t.shape)
            rows = shallow_tree(g.sum(1), h.sum(1), 2, least)  # a first cut on one feature, then one cut of the other in each half
            step = np.zeros_like(t)
            for value in np.unique(rows):
                half = rows == value
                step[half] = shallow_tree(g[half].sum(0), h[half].sum(0), 2, least)
            t += rate * step
            total += (rate * step).ravel()[c]
    centre = 0.0
    for b, t in zip(at, model.tables, strict=True):
        centre += (mean := t[b].mean())
        t -= mean
    model.intercept += centre
    return model
