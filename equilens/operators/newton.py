"""L2-penalised logistic regression of many variants of one table at once, by Newton steps.

A variant regroups the one-hot slots of the table's columns (merged categories share a slot).
All variants are fitted side by side: one pass over the rows for each step returns, for every
variant, loss, gradient and Hessian in the slots of the whole table; the variant's own follow
by adding slots up.  Tasks send one packed row for each variant, and these are added up
in two rounds (the first spreads a variant's rows over ``SALT`` partitions), so no task or
driver holds a row for each task of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASS_DOUBLES = 8_000_000      # doubles of gradients and Hessians that one pass carries in a task, about
SALT = 32
MAX_STEPS = 60
TOLERANCE = 1e-10             # of the loss that one more step could win, for each row


@dataclass(frozen=True)
class Design:
    """Columns of the whole table: numbers, one slot for each level of each category, intercept last."""

    numerical: tuple
    levels: dict                                   # category -> its levels as text, ascending

    @property
    def width(self) -> int:
        return len(self.numerical) + sum(map(len, self.levels.values())) + 1

    def start(self, column: str) -> int:
        """First slot of a category."""
        at = len(self.numerical)
        for c, values in self.levels.items():
            if c == column:
                return at
            at += len(values)
        raise KeyError(column)

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows as numbers; a level that the design does not know has no slot."""
        n = batch.num_rows
        out = np.zeros((n, self.width))
        for i in range(len(self.numerical)):
            out[:, i] = batch.column(f"n{i}").to_numpy(zero_copy_only=False)
        for i, (c, values) in enumerate(self.levels.items()):
            code = pc.fill_null(pc.index_in(batch.column(f"c{i}"), value_set=pa.array(values, pa.string())), -1)
            code = code.to_numpy(zero_copy_only=False)
            seen = np.flatnonzero(code >= 0)
            out[seen, self.start(c) + code[seen]] = 1.0
        out[:, -1] = 1.0
        return out

    def rows(self, df: DataFrame, label: str) -> DataFrame:
        """What the tasks read; rows with a null, not-a-number or infinite number, or no label, are left out."""
        numbers = [F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(self.numerical)]
        texts = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(self.levels)]
        out = df.select(F.col(label).cast("double").alias("y"), *numbers, *texts).where("y IS NOT NULL")
        for i in range(len(numbers)):
            out = out.where(F.col(f"n{i}").isNotNull() & ~F.isnan(f"n{i}") & (F.abs(F.col(f"n{i}")) != float("inf")))
        return out


def levels_of(df: DataFrame, categorical) -> dict:
    """Distinct values of each category as text, ascending, by one aggregate.

    They are slots of the model, so they are as many as its coefficients.
    """
    if not categorical:
        return {}
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical]))
    found: dict = {c: [] for c in categorical}
    for r in df.select(items.alias("i")).select("i.*").where("v IS NOT NULL").distinct().collect():
        found[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in found.items()}


def slots(design: Design, merged: dict | None = None, trained: dict | None = None) -> np.ndarray:
    """Coefficient of each slot of the design, -1 for none; the intercept has the last one.

    ``merged`` maps a category's levels to what they become; ``trained`` holds the levels that the
    train rows have where these are not all.  The first level of a category, after merging, and
    levels that no train row has get no coefficient.
    """
    out = np.full(design.width, -1)
    out[:len(design.numerical)] = np.arange(len(design.numerical))
    n = len(design.numerical)
    for c, values in design.levels.items():
        becomes = [(merged or {}).get(c, {}).get(v, v) for v in values]
        have = sorted({b for v, b in zip(values, becomes) if v in (trained or {}).get(c, values)})
        number = {b: n + i for i, b in enumerate(have[1:])}
        for i, b in enumerate(becomes):
            out[design.start(c) + i] = number.get(b, -1)
        n += len(number)
    out[-1] = n
    return out


def _spread(slot: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Coefficients in the slots of the whole table."""
    return np.where(slot >= 0, w[np.maximum(slot, 0)], 0.0)


def _sums(packed: DataFrame) -> DataFrame:
    """``(variant, v)`` rows of packed doubles added up by variant, in two rounds."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("variant").to_pylist(), batch.column("v")):
                x = np.frombuffer(v.as_py())
                held[k] = held[k] + x if k in held else x
        yield from _packed(held)

    parts = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    first = packed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    first = first.repartition(parts, "variant", "salt").select("variant", "v").mapInArrow(add, "variant int, v binary")
    return first.repartition(parts, "variant").mapInArrow(add, "variant int, v binary")


def _packed(held: dict) -> Iterator[pa.RecordBatch]:
    for k, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["variant", "v"])


def _pass(rows: DataFrame, design: Design, full: dict, measure) -> dict:
    """``measure(matrix, labels, scores of a variant)`` added up over all rows, for each variant in ``full``."""
    names = sorted(full)
    weights = np.array([full[k] for k in names]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = design.matrix(batch), batch.column("y").to_numpy()
            eta = x @ weights
            for i, k in enumerate(names):
                got = measure(x, y, eta[:, i])
                held[k] = held[k] + got if k in held else got
        yield from _packed(held)

    return {r["variant"]: np.frombuffer(r["v"]) for r in _sums(rows.mapInArrow(run, "variant int, v binary")).collect()}


def _curvature(x: np.ndarray, y: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and Hessian of the logistic loss, packed."""
    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
    loss = np.logaddexp(0.0, eta).sum() - (y * eta).sum()
    return np.concatenate([[len(y), loss], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


def _hits(x: np.ndarray, y: np.ndarray, eta: np.ndarray) -> np.ndarray:
    return np.array([len(y), ((eta > 0) == (y > 0)).sum()], float)


def _own(slot: np.ndarray, got: np.ndarray, w: np.ndarray, penalty: float):
    """Rows, penalised loss, gradient and Hessian of a variant's own coefficients."""
    width, own = len(slot), len(w)
    group = np.zeros((width, own))
    used = np.flatnonzero(slot >= 0)
    group[used, slot[used]] = 1.0
    ridge = np.full(own, penalty)
    ridge[-1] = 0.0                                # the intercept is free
    loss = got[1] + (ridge * w * w).sum() / 2
    return got[0], loss, group.T @ got[2:2 + width] + ridge * w, group.T @ got[2 + width:].reshape(width, width) @ group + np.diag(ridge)


def _direction(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    scale = 1.0 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))
    return -scale * np.linalg.lstsq(hessian * scale[:, None] * scale[None, :], scale * gradient, rcond=1e-15)[0]


def fit(rows: DataFrame, design: Design, variants: list, penalty: float = 1.0) -> list:
    """Coefficients of every variant (a list of :func:`slots`), the intercept last.

    Minimises the summed logistic loss plus ``penalty / 2`` times the squared coefficients.  A step
    that would raise the loss is halved.  Variants that are done drop out of the next pass.  Without
    rows all coefficients are 0.
    """
    rows = rows.persist()                          # every step reads them; they spill to disk
    try:
        return _newton(rows, design, variants, penalty)
    finally:
        rows.unpersist()


def _newton(rows: DataFrame, design: Design, variants: list, penalty: float) -> list:
    out = [np.zeros(v[-1] + 1) for v in variants]
    per_pass = max(1, PASS_DOUBLES // (design.width * (design.width + 1) + 2))
    for first in range(0, len(variants), per_pass):
        group = range(first, min(first + per_pass, len(variants)))
        last = {k: (np.inf, out[k]) for k in group}
        for _ in range(MAX_STEPS):
            got = _pass(rows, design, {k: _spread(variants[k], out[k]) for k in last}, _curvature)
            for k in list(last):
                if k not in got:                   # no rows
                    del last[k]
                    continue
                n, loss, gradient, hessian = _own(variants[k], got[k], out[k], penalty)
                before, where = last[k]
                if loss > before + 1e-12 * abs(before):
                    out[k] = (out[k] + where) / 2
                    continue
                move = _direction(gradient, hessian)
                last[k] = (loss, out[k])
                out[k] = out[k] + move
                if -gradient @ move <= TOLERANCE * n:
                    del last[k]
            if not last:
                break
    return out


def accuracies(rows: DataFrame, design: Design, variants: list, coefficients: list) -> list:
    """Share of rows that each variant's model predicts right (null without rows), in one pass."""
    full = {k: _spread(v, w) for k, (v, w) in enumerate(zip(variants, coefficients))}
    got = _pass(rows, design, full, _hits) if full else {}
    return [float(got[k][1] / got[k][0]) if k in got else None for k in full]


def coefficient_table(train: DataFrame, numerical, categorical, label: str) -> DataFrame:
    """``(term, level, coefficient)`` of the model with penalty 1; the first level of a category has none.

    The intercept is the term ``''``.
    """
    design = Design(tuple(numerical), levels_of(train, categorical))
    slot = slots(design)
    w = fit(design.rows(train, label), design, [slot])[0]
    terms = [(c, None) for c in numerical] + [(c, v) for c, values in design.levels.items() for v in values] + [("", None)]
    rows = [(t, v, float(w[s])) for (t, v), s in zip(terms, slot) if s >= 0]
    return train.sparkSession.createDataFrame(rows, "term string, level string, coefficient double")


def merge_accuracies(train: DataFrame, test: DataFrame, numerical, categorical, attr: str, label: str, changes: dict | None = None) -> list:
    """``(from, to, accuracy)`` of the model refitted with each pair of values of ``attr`` merged, in order of the pairs.

    ``attr`` holds its base values and ``changes`` the ordered merges made before; the values that
    are paired are those after them.  Every pair is one variant.
    """
    from itertools import combinations

    from equilens.functions.transforms import compose_rebin
    before = {str(k): str(v) for k, v in (changes or {}).items()}
    trained = levels_of(train, categorical)
    held_out = levels_of(test, [attr])[attr]
    levels = {**trained, attr: sorted({*trained[attr], *held_out})}
    design = Design(tuple(numerical), levels)
    done = compose_rebin(before)
    now = sorted({done.get(v, v) for v in levels[attr]})
    pairs = list(combinations(now, 2))
    variants = []
    for old, new in pairs:
        change = compose_rebin({**before, old: new})
        variants.append(slots(design, {attr: {v: change.get(v, v) for v in levels[attr]}}, {attr: trained[attr]}))
    w = fit(design.rows(train, label), design, variants)
    return [(a, b, acc) for (a, b), acc in zip(pairs, accuracies(design.rows(test, label), design, variants, w))]
