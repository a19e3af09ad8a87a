"""Feature columns as small whole numbers (cells), the form in which the tree learners read the rows.

A numeric column has one cell between any two neighbouring cuts, a category one for each level and one
for its first level, unseen and null ones.  The features are those of :func:`models.feature_stages`: the
numbers, then one for each level but the first, levels descending.  A split sends the rows of a range of cells to the right.
Rows go into blocks of packed cells, written once; every pass of a learner reads the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators.newton import levels_of
from equilens.operators.sizing import written
from equilens.spec import AuditSpec

MAX_BINS = 32                 # of a number, as in the library
CUT_ROWS = 10_000             # rows whose values give the cuts, about; as in the library
BLOCK_ROWS = 16_384
TASK_ROWS = 1_000_000         # rows of one task of a pass, about


def cuts(values: np.ndarray, weights: np.ndarray, max_cuts: int | None) -> np.ndarray:
    """Ascending cuts midway between distinct values: all of them, or ``max_cuts`` at about equal weight apart."""
    if not len(values):
        return np.zeros(0)
    v, at = np.unique(values, return_inverse=True)
    middle = (v[:-1] + v[1:]) / 2.0
    if max_cuts is None or len(middle) <= max_cuts:
        return middle
    w = np.bincount(at, weights=weights)
    reached = np.cumsum(w)
    stride = reached[-1] / (max_cuts + 1)
    out, target = [], stride
    for i in range(1, len(v)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


class Cells:
    """Cells of all columns, numbered through, and the splits over them in the order of the features."""

    def __init__(self, numerical, cut_points, levels: dict):
        self.numerical, self.cuts, self.levels = tuple(numerical), list(cut_points), levels
        self.sizes = [len(c) + 1 for c in self.cuts] + [max(len(v), 1) for v in levels.values()]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)
        self.width = int(self.starts[-1])
        self.dtype = np.uint16 if self.width < 2 ** 16 else np.uint32
        column, low, high, feature, f = [], [], [], [], 0
        self.cell_feature = np.full(self.width, -1)             # -1: the cells of first levels
        for j, (start, size) in enumerate(zip(self.starts, self.sizes)):
            number = j < len(self.cuts)
            for k in range(size - 1):
                column.append(j)
                low.append(start + k + number)
                high.append(start + (size - 1 if number else k))
                feature.append(f + (0 if number else k))
            self.cell_feature[start:start + size - (not number)] = f if number else np.arange(f, f + size - 1)
            f += 1 if number else size - 1
        self.n_features = f
        self.column, self.low, self.high, self.feature = (np.array(a, np.int64) for a in (column, low, high, feature))
        self.by_level = self.column >= len(self.cuts)

    def encode(self, batch) -> np.ndarray:
        """Cells of the columns ``n0``.. and ``c0``.. of a batch, a row for each column.  Not-a-number is beyond every cut."""
        out = np.empty((len(self.sizes), batch.num_rows), self.dtype)
        for j, points in enumerate(self.cuts):
            x = np.asarray(batch.column(f"n{j}").to_numpy(zero_copy_only=False), float)
            out[j] = self.starts[j] + np.searchsorted(points, x, side="left")
        for i, values in enumerate(self.levels.values()):
            j = len(self.cuts) + i
            slots = pa.array(values[:0:-1], pa.string())
            code = pc.fill_null(pc.index_in(batch.column(f"c{i}"), value_set=slots), len(slots))
            out[j] = self.starts[j] + code.to_numpy(zero_copy_only=False)
        return out

    def rows(self, df: DataFrame, label: str | None = None, keep=()) -> DataFrame:
        """The feature columns as :meth:`encode` reads them.  With ``label``, rows to learn from: checked, as ``y``."""
        numbers, y = [F.col(c).cast("double") for c in self.numerical], []
        if label:
            bad = F.raise_error(F.lit("a number to learn from is null, not a number or infinite")).cast("double")
            numbers = [F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), bad).otherwise(x) for x in numbers]
            at = F.col(label).cast("double")
            odd = F.raise_error(F.lit("a label to learn from is not 0 or 1")).cast("double")
            y = [F.when(at.isin(0.0, 1.0), at).otherwise(odd).cast("byte").alias("y")]
        numbers = [x.alias(f"n{i}") for i, x in enumerate(numbers)]
        return df.select(*keep, *y, *numbers, *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(self.levels)])

    def right(self, splits: np.ndarray, x: np.ndarray, rows) -> np.ndarray:
        """Whether each row goes to the right of its split."""
        cell = x[self.column[splits], rows]
        return (cell >= self.low[splits]) & (cell <= self.high[splits])

    def sides(self, hist: np.ndarray, total: np.ndarray | None = None):
        """Sums left of every split, and of all rows, from sums by cell: ``(nodes, width, k)``."""
        total = hist[:, :self.sizes[0]].sum(axis=1) if total is None else total
        parts = []
        for j, (start, size) in enumerate(zip(self.starts, self.sizes)):
            h = hist[:, start:start + size - 1]
            parts.append(np.cumsum(h, axis=1) if j < len(self.cuts) else total[:, None] - h)
        return np.concatenate(parts, axis=1), total


def learn(train: DataFrame, spec: AuditSpec, label: str, max_bins: int | None = MAX_BINS):
    """The cells of the train rows, how many rows these are, and the rows (a batch) whose values gave the cuts.

    As in the library, cuts come from about ``CUT_ROWS`` rows.  ``max_bins`` None keeps every cut between their values.
    """
    n = train.count()
    cells = Cells(spec.numerical, [np.zeros(0)] * len(spec.numerical), levels_of(train, spec.categorical))
    rows = cells.rows(train, label)
    if n > CUT_ROWS:
        rows = rows.sample(False, CUT_ROWS / n, 0)
    seen = pa.Table.combine_chunks(rows.toArrow())
    values = [seen.column(f"n{j}").to_numpy() for j in range(len(spec.numerical))]
    most = None if max_bins is None else min(max_bins, max(n, 1)) - 1
    return Cells(spec.numerical, [cuts(v, np.ones(len(v)), most) for v in values], cells.levels), n, seen


def blocks(train: DataFrame, cells: Cells, n: int, label: str, numbers: bool = False) -> RDD:
    """``(id, cells, labels)`` of blocks of train rows, from a table written once and dealt evenly.

    With ``numbers``, the numbers follow as they are, a row for each column.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, at = [], 0, TaskContext.get().partitionId() << 32

        def packed():
            t = pa.Table.from_batches(held).combine_chunks()
            y = t.column("y").to_numpy().astype(np.int8)
            raw = [t.column(f"n{j}").to_numpy() for j in range(len(cells.cuts))] if numbers else []
            packed = [cells.encode(t).tobytes(), y.tobytes(), np.array(raw, float).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *[pa.array([b], pa.binary()) for b in packed]], names=["id", "x", "y", "v"])
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield packed()
                held, count, at = [], 0, at + 1
        if count:
            yield packed()

    def unpack(r):
        y = np.frombuffer(bytes(r["y"]), np.int8)
        x = np.frombuffer(bytes(r["x"]), cells.dtype).reshape(-1, len(y))
        return (r["id"], x, y, np.frombuffer(bytes(r["v"])).reshape(-1, len(y))) if numbers else (r["id"], x, y)

    sc = train.sparkSession.sparkContext
    parts, at_once = math.ceil(n / TASK_ROWS), sc.defaultParallelism
    # whole rounds of tasks where there are several, so that no pass waits for a last few
    parts = max(min(at_once, math.ceil(n / 1000)), 1) if parts <= at_once else math.ceil(parts / at_once) * at_once
    packed = cells.rows(train, label).mapInArrow(pack, "id long, x binary, y binary, v binary")
    return written(packed.repartition(parts), "blocks").rdd.map(unpack)


def scored(df: DataFrame, cells: Cells, spec: AuditSpec, label: str, keep, predict) -> DataFrame:
    """Rows with ``predict(cells) -> (hard label, score)``, in the layout of :func:`models.score`."""
    columns = [f"n{i}" for i in range(len(cells.cuts))] + [f"c{i}" for i in range(len(cells.levels))]
    # ``predict`` gets the numbers as they are, too, where it asks for them
    asks_numbers = getattr(predict, "numbers", False)

    @F.arrow_udf("struct<p:int,s:double>")
    def run(*arrays: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(arrays), names=columns)
        raw = [np.array([np.asarray(batch.column(j).to_numpy(zero_copy_only=False), float) for j in range(len(cells.cuts))])] if asks_numbers else []
        p, s = predict(cells.encode(batch), *raw)
        return pa.StructArray.from_arrays([pa.array(p, pa.int32()), pa.array(s, pa.float64())], names=["p", "s"])

    # no expression of the rows' own names may clash with the feature columns
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)] + [F.col(label).cast("int").alias("label")] \
        + [F.col(c).alias(f"o{i}") for i, c in enumerate(spec.protected)]
    out = cells.rows(df, keep=own).withColumn("r", run(*columns))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("label").alias("label_Y"), F.col("r.p").alias("pred_Y"),
                      F.col("r.s").alias("score_S"), *[F.col(f"o{i}").alias(c) for i, c in enumerate(spec.protected)])
