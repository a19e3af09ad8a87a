"""AdaBoost (SAMME, two classes) with decision stumps, one pass over the rows for each round.

A stump looks at one column, so the sum of all stumps is one number for each cell of each column, and a
row's weight follows from its cells and its label: no weight is stored, and the rows stay as they were written.
A pass adds the weights up by cell and label; the round's stump, its error and its alpha follow from these sums.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from equilens.operators import cells as cl
from equilens.operators.trees import gini_gain
from equilens.spec import AuditSpec

CHUNK_ROWS = 500_000


def _sums(cells: cl.Cells, votes: np.ndarray, base: float):
    """Weights by label and cell of a task's blocks; ``weight = exp(base - t votes / 2)`` with t = 1 or -1."""
    def run(blocks):
        out, held = np.zeros((2, cells.width)), []

        def add():
            x, y = np.concatenate([b[1] for b in held], axis=1), np.concatenate([b[2] for b in held])
            w = weights(x, y, votes, base)
            for j, (start, size) in enumerate(zip(cells.starts, cells.sizes)):
                at = x[j].astype(np.int64) - start + y * np.int64(size)
                out[:, start:start + size] += np.bincount(at, weights=w, minlength=2 * size).reshape(2, size)
        for b in blocks:
            held.append(b)
            if sum(len(h[2]) for h in held) >= CHUNK_ROWS:
                add()
                held = []
        if held:
            add()
        yield out
    return run


def weights(x: np.ndarray, y: np.ndarray, votes: np.ndarray, base: float) -> np.ndarray:
    return np.exp(base - (2 * y - 1) * _decision(x, votes) / 2)


def _decision(x: np.ndarray, votes: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for column in x:
        out += votes[column]
    return out


def fit_adaboost(train: DataFrame, spec: AuditSpec, label: str = "label_Y", n_estimators: int = 50, learning_rate: float = 1.0):
    """Cells, the votes of all stumps by cell, and the alphas.

    A round's cuts lie at about equal weights apart, by the round's weights, as in the library: they are
    chosen among all cuts between the values of the rows that give them.
    """
    cells, n, seen = cl.learn(train, spec, label, None)
    rows = cl.blocks(train, cells, n, label)
    x, y = cells.encode(seen), seen.column("y").to_numpy().astype(np.int8)
    values = [seen.column(f"n{j}").to_numpy() for j in range(len(cells.cuts))]
    most = min(cl.MAX_BINS, max(n, 1)) - 1
    votes, base, alphas = np.zeros(cells.width), -math.log(max(n, 1)), []
    for _ in range(n_estimators):
        w = weights(x, y, votes, base)
        offered = [cl.cuts(v, w, most) for v in values]
        sums = rows.mapPartitions(_sums(cells, votes, base)).treeReduce(np.add)
        vote, err = _stump(cells, sums.T, offered)
        if err <= 0 or err >= 0.5:                 # perfect, or no better than chance for two classes
            if err <= 0 or not alphas:
                alphas.append(1.0)
                votes = votes + vote
            break
        alpha = learning_rate * math.log((1 - err) / err)
        alphas.append(alpha)
        votes = votes + alpha * vote
        # weights grow by e^alpha where the stump is wrong and are divided by their new total
        base += alpha / 2 - math.log((1 - err) + err * math.exp(alpha))
    return cells, votes, alphas


def _stump(cells: cl.Cells, sums: np.ndarray, offered):
    """Votes (1 or -1, in the cells of the stump's column) of the best stump and its share of wrong weight."""
    left, total = cells.sides(sums[None])
    use = np.ones(len(cells.feature), bool)
    for j, points in enumerate(offered):
        at = np.flatnonzero(cells.column == j)
        use[at] = np.isin(cells.cuts[j], points)
    best, gain = 0, -np.inf
    if use.any():
        gains = np.where(use, gini_gain(left, total, cells.by_level)[0], -np.inf)
        best = int(np.argmax(gains))
        gain = gains[best]
    t = total[0]
    sides = [left[0, best], t - left[0, best]] if gain > 0 else [t, t]
    says = [int(s[1] > s[0]) for s in sides]
    vote = np.zeros(cells.width)
    if says[0] == says[1]:                         # no split, or both sides say the same
        vote[:cells.sizes[0]] = 2 * says[0] - 1
        return vote, t[1 - says[0]] / t.sum()
    j = cells.column[best]
    vote[cells.starts[j]:cells.starts[j + 1]] = 2 * says[0] - 1
    vote[cells.low[best]:cells.high[best] + 1] = 2 * says[1] - 1
    return vote, (sides[0][1 - says[0]] + sides[1][1 - says[1]]) / t.sum()


def score_adaboost(model, df: DataFrame, spec: AuditSpec, label: str = "label_Y", keep=()) -> DataFrame:
    """decision = sum_m alpha_m (2 h_m(x) - 1) / sum alpha; P(y=1) = 1 / (1 + exp(-decision))."""
    cells, votes, alphas = model
    total = sum(alphas)

    def predict(x):
        d = _decision(x, votes) / total
        return (d > 0).astype(np.int32), 1.0 / (1.0 + np.exp(-d))
    return cl.scored(df, cells, spec, label, keep, predict)
