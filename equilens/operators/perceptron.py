"""Multilayer perceptron (one hidden sigmoid layer, softmax) by L-BFGS, one pass over blocks of rows for each evaluation.

The library stores every row as a dense vector with one number for each level of each category.  Here a row
keeps its numbers and one code for each category, and the rows of a task are sorted by the category with most
levels: its part of the first layer is a lookup, and its part of the gradient a sum over runs of equal codes.
Inside a run they are sorted by a number, so that hidden units far from 0 are so for whole chunks and need no exponentials.
Starting weights are the library's; steps, line search and stopping rules are those of its optimiser.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from equilens.operators import cells as cl
from equilens.operators.newton import levels_of
from equilens.spec import AuditSpec

CHUNK_ROWS = 512               # rows whose hidden layer is held at once, near the processor
MAX_RUNS = 16                 # of equal codes in a chunk that are added one by one
FAR, ONE = 100.0, 40.0        # scores beyond which a hidden unit is 0, or 1, in doubles
MEMORY = 10                   # steps that shape the next one


class Design:
    """Slots of the first layer: the numbers, then each category's levels but the first, descending."""

    def __init__(self, cells: cl.Cells):
        self.cells = cells
        k, self.numbers = len(cells.cuts), len(cells.cuts)
        at = k + np.concatenate([[0], np.cumsum([s - 1 for s in cells.sizes[k:]])]).astype(int)
        self.slots = {k + i: (int(at[i]), int(at[i + 1])) for i in range(len(cells.sizes) - k)}
        self.inputs = int(at[-1])
        self.most = max(self.slots, key=lambda j: cells.sizes[j], default=None)

    def sorted(self, blocks):
        """Numbers by row, codes, labels of a task's rows, sorted by the category with most levels and by the number of the widest range."""
        held = list(blocks)                                    # a bounded number of packed rows
        if held:
            x, y, v = (np.concatenate([b[i] for b in held], axis=-1) for i in (1, 2, 3))
            wide = [v[np.argmax(np.ptp(v, axis=1))]] if len(v) else [np.zeros(len(y))]
            order = np.lexsort((*wide, *([] if self.most is None else [x[self.most]])))
            for a in range(0, len(y), cl.BLOCK_ROWS):
                r = order[a:a + cl.BLOCK_ROWS]
                yield np.ascontiguousarray(v[:, r].T), np.ascontiguousarray(x[:, r]), y[r]

    def dense(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Every slot but those of the category with most levels, and 1 for the intercept."""
        keep = [(j, a, b) for j, (a, b) in self.slots.items() if j != self.most]
        out = np.zeros((len(v), self.numbers + sum(b - a for _, a, b in keep) + 1))
        out[:, :self.numbers] = v
        out[:, -1] = 1.0
        place = self.numbers
        for j, a, b in keep:
            code = x[j].astype(np.int64) - self.cells.starts[j]
            hit = np.flatnonzero(code < b - a)
            out[hit, place + code[hit]] = 1.0
            place += b - a
        return out

    def split(self, w: np.ndarray, hidden: int):
        """First layer of :meth:`dense`, rows of the category with most levels (the last: none), second layer."""
        n = self.inputs * hidden
        first, bias = w[:n].reshape(self.inputs, hidden), w[n:n + hidden]
        second, out = w[n + hidden:-2].reshape(hidden, 2), w[-2:]
        a, b = self.slots.get(self.most, (self.inputs, self.inputs))
        table = np.vstack([first[a:b], np.zeros((1, hidden))])
        return np.vstack([first[:a], first[b:], bias[None]]), table, second, out

    def joined(self, dense: np.ndarray, table: np.ndarray, second: np.ndarray, out: np.ndarray) -> np.ndarray:
        a, _ = self.slots.get(self.most, (self.inputs, self.inputs))
        first = np.vstack([dense[:a], table[:-1], dense[a:-1]])
        return np.concatenate([first.ravel(), dense[-1], second.ravel(), out])

    def codes(self, x) -> np.ndarray:
        return x[self.most].astype(np.int64) - self.cells.starts[self.most]

    def hidden(self, d, x, dense, table) -> np.ndarray:
        z = d @ dense
        if self.most is not None:
            z += table[self.codes(x)]
        np.negative(z, out=z)
        return _sigmoid_of_minus(z)


def _sigmoid_of_minus(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(z)) in place.  Beyond ``FAR`` nothing is added to any sum, and numbers too small for full precision are slow."""
    np.clip(z, -FAR, FAR, out=z)
    np.exp(z, out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


def _sums(design: Design, w: np.ndarray, hidden: int):
    """Rows, cross entropy and gradient of a task's blocks.

    The two outputs' errors are e and -e, so both layers' gradients are sums of rows times e: no row is multiplied by the
    second layer.  Rows of a chunk come in runs of equal codes, which share their row of the table.
    """
    dense, table, second, out = design.split(w, hidden)
    minus, minus_table, apart, out_apart = -dense, -table, second[:, 1] - second[:, 0], out[1] - out[0]

    def run(blocks):
        n, loss = 0, 0.0
        g_dense, g_table, g_hidden, g_out = np.zeros_like(dense), np.zeros_like(table), np.zeros(hidden), 0.0
        held = np.empty((2, CHUNK_ROWS, hidden))
        for v_all, x_all, y_all in blocks:
            n += len(y_all)
            for a in range(0, len(y_all), CHUNK_ROWS):
                r = slice(a, a + CHUNK_ROWS)
                v, x, y = v_all[r], x_all[:, r], y_all[r]
                z, slope = held[0, :len(y)], held[1, :len(y)]
                d = design.dense(v, x)
                np.matmul(d, minus, out=z)
                if design.most is not None:
                    code = design.codes(x)
                    edges = np.concatenate([[0], 1 + np.flatnonzero(np.diff(code))])
                    runs = list(zip(code[edges], edges, [*edges[1:], len(y)])) if len(edges) <= MAX_RUNS else None
                    if runs is None:
                        z += minus_table[code]
                    else:
                        for c, b, to in runs:
                            z[b:to] += minus_table[c]
                # a unit that is 1 or 0 for all rows of the chunk has no slope; on raw numbers these are most units
                least, most = z.min(axis=0), z.max(axis=0)
                ones = most <= -ONE
                live = np.flatnonzero(~ones & (least < FAR))
                if len(live) < 0.8 * hidden:
                    z = z[:, live]
                    slope = np.empty_like(z)
                else:
                    ones, live = np.zeros(hidden, bool), slice(None)
                h = _sigmoid_of_minus(z)
                raw = h @ apart[live]
                raw += out_apart + apart[ones].sum()
                e = np.exp(-np.abs(raw))
                loss += float((np.log1p(e) + np.maximum(raw, 0.0) - y * raw).sum())
                e = np.where(raw >= 0, 1.0, e) / (1.0 + e) - y
                g_hidden[live] += e @ h
                g_hidden[ones] += e.sum()
                g_out += e.sum()
                np.multiply(h, h, out=slope)
                np.subtract(h, slope, out=slope)
                d *= e[:, None]
                g_dense[:, live] += d.T @ slope
                if design.most is not None:
                    if runs is None:
                        slope *= e[:, None]
                        g_table[code[edges][:, None], np.arange(hidden)[live]] += np.add.reduceat(slope, edges, axis=0)
                    else:
                        for c, b, to in runs:
                            g_table[c, live] += e[b:to] @ slope[b:to]
        g_second, g_outs = np.stack([-g_hidden, g_hidden], axis=1), np.array([-g_out, g_out])
        yield np.concatenate([[n, loss], design.joined(g_dense * apart, g_table * apart, g_second, g_outs)])
    return run


class _Failed(Exception):
    """No step could be found."""


def _line_search(phi, first: float) -> float:
    """A step that meets the strong Wolfe conditions; ``phi(t)`` gives value and slope."""
    value0, slope0 = phi(0.0)
    if slope0 > 0:
        raise _Failed
    low = (0.0, slope0, value0)

    def between(a, b):
        if a[0] > b[0]:
            a, b = b, a
        with np.errstate(all="ignore"):
            d1 = a[1] + b[1] - 3 * (a[2] - b[2]) / np.float64(a[0] - b[0])
            d2 = np.sqrt(d1 * d1 - a[1] * b[1])
            t = float(b[0] - (b[0] - a[0]) * (b[1] + d2 - d1) / (b[1] - a[1] + 2 * d2))
        lowest, highest = a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])
        return lowest if t < lowest else highest if t > highest else t

    def zoom(low, high):
        for _ in range(10):
            t = between(low, high)
            value, slope = phi(t)
            c = (t, slope, value)
            if value > value0 + 1e-4 * t * slope0 or value >= low[2]:
                high = c
            else:
                if abs(slope) <= 0.9 * abs(slope0):
                    return t
                if slope * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    t = first
    for i in range(10):
        value, slope = phi(t)
        c = (t, slope, value)
        if not math.isfinite(value):
            t /= 2.0
            continue
        if value > value0 + 1e-4 * t * slope0 or (value >= low[2] and i > 0):
            return zoom(low, c)
        if abs(slope) <= 0.9 * abs(slope0):
            return t
        if slope >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed


def _direction(gradient: np.ndarray, steps: list, turns: list) -> np.ndarray:
    """Two-loop recursion over the last steps (newest first) and the changes of the gradient with them."""
    d, alphas = gradient.copy(), []
    for s, g in zip(steps, turns):
        alphas.append(s @ d / (s @ g))
        if math.isnan(alphas[-1]):
            raise _Failed
        d -= alphas[-1] * g
    if steps:
        sy = steps[0] @ turns[0]
        if sy < 0 or math.isnan(sy):
            raise _Failed
        d *= sy / (turns[0] @ turns[0])
    for s, g, alpha in reversed(list(zip(steps, turns, alphas))):
        d += (alpha - g @ d / (s @ g)) * s
    return -d


def minimise(calculate, w: np.ndarray, max_iter: int, tolerance: float) -> np.ndarray:
    """``calculate(w)`` gives loss and gradient; stops where the last 20 losses or the gradient hardly change."""
    last = [None, None]

    def at(x):
        if last[0] is None or not np.array_equal(last[0], x):
            last[:] = [x, calculate(x)]
        return last[1]

    loss, gradient = at(w)
    first_loss, losses, steps, turns, done, failed = loss, [loss], [], [], 0, False
    while done < max_iter:
        if len(losses) >= 2 and abs(loss - max(losses)) <= tolerance * first_loss:
            break
        if np.linalg.norm(gradient) <= max(tolerance * loss, 1e-8):
            break
        try:
            d = _direction(gradient, steps, turns)

            def phi(t, w=w, d=d):
                value, g = at(w + t * d)
                return value, float(g @ d)
            step = _line_search(phi, 1.0 if done else 1.0 / np.linalg.norm(d))
            if step * np.linalg.norm(gradient) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, steps, turns = True, [], []
            continue
        failed, new = False, w + step * d
        new_loss, new_gradient = at(new)
        steps, turns = [step * d, *steps][:MEMORY], [new_gradient - gradient, *turns][:MEMORY]
        w, loss, gradient, done = new, new_loss, new_gradient, done + 1
        losses = [*losses, loss][-20:]
    return w


def fit_mlp(train: DataFrame, spec: AuditSpec, classifier, label: str = "label_Y"):
    """Design and weights; ``classifier("MLP", n_features=n)`` holds the parameters."""
    n = train.count()
    cells = cl.Cells(spec.numerical, [np.zeros(0)] * len(spec.numerical), levels_of(train, spec.categorical))
    design = Design(cells)
    clf = classifier("MLP", n_features=design.inputs, label="y")
    hidden = clf.getLayers()[1]
    # without a step the library returns its starting weights
    two = train.sparkSession.createDataFrame([(Vectors.sparse(design.inputs, {}), float(i)) for i in (0, 1)], ["features", "y"])
    start = clf.copy({clf.maxIter: 0}).fit(two).weights.toArray()
    rows = cl.blocks(train, cells, n, label, numbers=True).mapPartitions(design.sorted).persist(StorageLevel.MEMORY_AND_DISK)

    def calculate(w):
        got = rows.mapPartitions(_sums(design, w, hidden)).treeReduce(np.add)
        return float(got[1] / got[0]), got[2:] / got[0]

    w = minimise(calculate, start, clf.getMaxIter(), clf.getTol())
    rows.unpersist()
    return design, w, hidden


def score_mlp(model, df: DataFrame, spec: AuditSpec, label: str = "label_Y", keep=()) -> DataFrame:
    design, w, hidden = model
    dense, table, second, out = design.split(w, hidden)

    def predict(x, v):
        raw = np.empty((x.shape[1], 2))
        for a in range(0, len(raw), CHUNK_ROWS):
            r = slice(a, a + CHUNK_ROWS)
            raw[r] = design.hidden(design.dense(v[:, r].T, x[:, r]), x[:, r], dense, table) @ second + out
        with np.errstate(over="ignore"):
            return (raw[:, 1] > raw[:, 0]).astype(np.int32), 1.0 / (1.0 + np.exp(raw[:, 0] - raw[:, 1]))
    predict.numbers = True
    return cl.scored(df, design.cells, spec, label, keep, predict)
