"""Exact hard-negative mining with an inverted multi-index.

Vectors are cut into two halves, each half-space has a codebook, and the pair of nearest codes
is a vector's cell.  For a query ``q`` no vector of cell ``(i, j)`` scores above
``q1.c1[i] + |q1| r1[i]  +  q2.c2[j] + |q2| r2[j]``, where the radii ``r`` are the greatest
distances of all rows from their codes; with minus signs the same sum is a lower bound.  A
multi-sequence heap visits cells by falling sums of the two sorted half-bound lists and stops
once a result is certified: no cell left can hold a score that belongs into it.

Cells are packed in order into blocks of some thousand rows, large cells into several blocks by
a hash of the row, so equal vectors never crowd one task.  A query goes to the blocks whose cells
its bounds do not exclude.  First an anchor looks into its own block, which bounds its positives
from below; then its positives are searched in all blocks that may hold better ones; then its
negatives, in the score windows that the positives set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import materialize
from equilens.llm.topk_search import _matrix, _products

N_CODES, SAMPLE, BLOCK_ROWS, STEP_ROWS, QUERY_BATCH = 16, 4096, 8192, 1024, 512
NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------- index

def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (codes * codes).sum(axis=1) - 2 * x @ codes.T, 0.0))


def _codebook(x: np.ndarray, n_codes: int) -> np.ndarray:
    """Codes of a half-space: far apart first, then a few rounds of means."""
    pick, near = [0], _distances(x, x[:1])[:, 0]
    while len(pick) < min(n_codes, len(x)) and near.max() > 0:
        pick.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[pick[-1:]])[:, 0])
    codes = x[pick]
    for _ in range(5):
        own = _distances(x, codes).argmin(axis=1)
        codes = np.array([x[own == c].mean(axis=0) if (own == c).any() else codes[c] for c in range(len(codes))])
    return codes


class MultiIndex:
    """Two codebooks, fitted on a bounded sample, and the radii of their codes over all rows."""

    def __init__(self, sample: np.ndarray, dim: int, n_codes: int):
        self.dim, self.cut = dim, -(-dim // 2)
        x = sample.astype(np.float64)
        self.codes = [_codebook(x[:, :self.cut], n_codes), _codebook(x[:, self.cut:], n_codes)]
        self.radii = [np.zeros(len(c)) for c in self.codes]

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        f = x.astype(np.float64)
        return [f[:, :self.cut], f[:, self.cut:]]

    def key(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Code and distance from it, for either half."""
        out = []
        for half, codes in zip(self.halves(x), self.codes):
            d = _distances(half, codes)
            code = d.argmin(axis=1)
            out.append((code, d[np.arange(len(x)), code]))
        return out

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bound of the half-scores of every code, rounding included."""
        high, low = [], []
        for half, codes, radii in zip(self.halves(q), self.codes, self.radii):
            middle, norm = half @ codes.T, np.sqrt((half * half).sum(axis=1))[:, None]
            size = norm * (np.sqrt((codes * codes).sum(axis=1)) + radii)
            slack = norm * radii + 1e-7 * size + 1
            high.append(middle + slack)
            low.append(middle - slack)
        return high, low


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """All cells ``(i, j, bound)`` by falling sum of the half-bounds: the multi-sequence algorithm."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap, reached = [(-(x[0] + y[0]), 0, 0)], [0] * len(a)    # reached[p]: how far row p has been visited
    while heap:
        bound, p, r = heappop(heap)
        yield a[p], b[r], -bound
        reached[p] = r + 1
        if p + 1 < len(a) and reached[p + 1] == r:
            heappush(heap, (-(x[p + 1] + y[r]), p + 1, r))
        if r + 1 < len(b) and (p == 0 or reached[p - 1] > r + 1):
            heappush(heap, (-(x[p] + y[r + 1]), p, r + 1))


def build_index(rows: DataFrame, sample: int = SAMPLE, n_codes: int = N_CODES, block_rows: int = BLOCK_ROWS):
    """``rows`` (``uid, id, label, v``) with ``cell`` and ``block``; the index; and its directory of
    ``(cell, rows, first block, blocks)``, which has ``n_codes ** 2`` entries at most."""
    dim = rows.agg(F.max(F.size("v")).alias("dim")).first()["dim"]
    if not dim:
        return rows.select("*", F.lit(0).alias("cell"), F.lit(0).alias("block")), None, []
    picked = rows.orderBy(F.xxhash64("uid")).limit(sample).select("v").collect()
    index = MultiIndex(_matrix([r["v"] for r in picked], dim), dim, n_codes)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (i, ri), (j, rj) = index.key(_matrix(batch.column("v").to_pylist(), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(ri), pa.array(rj)],
                                                 names=[*batch.schema.names, "i", "j", "ri", "rj"])

    keyed = materialize(rows.mapInArrow(key, "uid long, id long, label long, v array<long>, i int, j int, ri double, rj double"), "cells")
    cells = sorted(keyed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("ri").alias("ri"), F.max("rj").alias("rj")).collect())
    directory, block, held = [], 0, 0
    for c in cells:
        index.radii[0][c["i"]] = max(index.radii[0][c["i"]], c["ri"])
        index.radii[1][c["j"]] = max(index.radii[1][c["j"]], c["rj"])
        parts = -(-c["n"] // block_rows)
        if held and (parts > 1 or held + c["n"] > block_rows):
            block, held = block + 1, 0
        directory.append((c["i"] * n_codes + c["j"], c["n"], block, parts))
        held += c["n"]
        if parts > 1:
            block, held = block + parts, 0
    of = {n: F.create_map(*[F.lit(x) for d in directory for x in (d[0], d[n])]) for n in (2, 3)}
    cell = F.col("i") * n_codes + F.col("j")
    at = F.element_at(of[2], cell) + F.pmod(F.xxhash64("uid"), F.element_at(of[3], cell)).cast("int")
    return keyed.select("uid", "id", "label", "v", cell.alias("cell"), at.cast("int").alias("block")), index, directory


# ---------------------------------------------------------------- search in a block

class Block:
    """The rows of a block, ordered by cell."""

    def __init__(self, index: MultiIndex, n_codes: int, uid, ids, label, cell, x):
        order = np.lexsort((ids, cell))
        self.uid, self.ids, self.label, self.x = uid[order], ids[order], label[order], x[order]
        cell = cell[order]
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.rows = {int(cell[a]): (int(a), int(b)) for a, b in zip(start, [*start[1:], len(cell)])}
        cells = np.array(list(self.rows))
        self.first, self.second = np.unique(cells // n_codes), np.unique(cells % n_codes)
        self.n_codes = n_codes

    def visit(self, q: np.ndarray, high, low, wanted: Callable, take: Callable) -> None:
        """Score the cells of the block by falling bound, some hundred rows at a time.

        ``wanted(upper, lower)`` is None where the search is over and false where the cell
        can't matter; ``take(rows, scores)`` sees every scored row.
        """
        held, n = [], 0
        for i, j, upper in cells_by_bound(high[0][self.first], high[1][self.second]):
            i, j = int(self.first[i]), int(self.second[j])
            want = wanted(upper, low[0][i] + low[1][j])
            if want is None:
                break
            span = self.rows.get(i * self.n_codes + j)
            if want and span:
                held.append(np.arange(*span))
                n += span[1] - span[0]
                if n >= STEP_ROWS:
                    rows = np.concatenate(held)
                    take(rows, _products(q[None, :], self.x[rows])[0])
                    held, n = [], 0
        if held:
            rows = np.concatenate(held)
            take(rows, _products(q[None, :], self.x[rows])[0])


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, ties by smaller id."""
    if len(ids) > 4 * k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _positives(block: Block, uid: int, label: int, q, high, low, floor: int, k: int):
    """First ``k`` other rows of the anchor's label in a block, if they reach ``floor``."""
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), floor]

    def take(rows, scores):
        good = (block.label[rows] == label) & (scores >= best[2]) & (block.uid[rows] != uid)
        if good.any():
            ids, top = _first(np.concatenate([best[0], block.ids[rows[good]]]), np.concatenate([best[1], scores[good]]), k)
            best[:] = ids, top, max(floor, int(top[-1])) if len(top) == k else floor

    block.visit(q, high, low, lambda upper, lower: None if upper < best[2] else True, take)
    return best[0], best[1]


def _negatives(block: Block, label: int, q, high, low, windows: list[tuple[int, int]], k: int):
    """For each score window the first ``k`` rows of other labels in a block."""
    best = [[np.zeros(0, np.int64), np.zeros(0, np.int64), floor] for floor, _ in windows]
    least, most = min(w[0] for w in windows), max(w[1] for w in windows)

    def wanted(upper, lower):
        if all(upper < b[2] for b in best):           # every window is certified
            return None
        return any(upper >= b[2] and lower <= w[1] for b, w in zip(best, windows))

    def take(rows, scores):
        good = (scores >= least) & (scores <= most) & (block.label[rows] != label)
        ids, scores = block.ids[rows[good]], scores[good]
        for b, (floor, ceiling) in zip(best, windows):
            fit = (scores >= b[2]) & (scores <= ceiling)
            if fit.any():
                who, top = _first(np.concatenate([b[0], ids[fit]]), np.concatenate([b[1], scores[fit]]), k)
                b[:] = who, top, int(top[-1]) if len(top) == k else floor

    block.visit(q, high, low, wanted, take)
    return [(b[0], b[1]) for b in best]


_ROW = "block int, kind int, uid long, id long, label long, cell int, v array<long>, floor long, scores array<long>"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]


def _stream(rows: DataFrame, index: MultiIndex, n_codes: int, schema: str, work: Callable) -> DataFrame:
    """Pass the query rows of each block (kind 1) by its data rows (kind 0), which come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(block)]):
                if a == b:
                    continue
                if block[a] != at:
                    at, held, ready = block[a], [], None
                for i in range(a, b, QUERY_BATCH):
                    part = batch.slice(i, min(QUERY_BATCH, b - i))
                    x = _matrix(part.column("v").to_pylist(), index.dim)
                    uid, label = part.column("uid").to_numpy(), part.column("label").to_numpy()
                    if kind[a] == 0:
                        held.append((uid, part.column("id").to_numpy(), label, part.column("cell").to_numpy(), x))
                    elif held:
                        if ready is None:
                            ready = Block(index, n_codes, *[np.concatenate(c) for c in zip(*held)])
                        high, low = index.bounds(x)
                        out = [work(ready, int(uid[r]), int(label[r]), x[r], [h[r] for h in high], [h[r] for h in low],
                                    part.column("floor")[r].as_py(), part.column("scores")[r].as_py()) for r in range(len(x))]
                        yield from out

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def _spread(queries: DataFrame, index: MultiIndex, directory: list, n_codes: int) -> DataFrame:
    """Query rows, once for each block that has a cell whose bound reaches the query's floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = np.array([d[0] for d in directory])
        blocks = np.concatenate([np.arange(d[2], d[2] + d[3]) for d in directory])
        of = np.repeat(np.arange(len(directory)), [d[3] for d in directory])
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_BATCH):
                part = whole.slice(i, QUERY_BATCH)
                high, _ = index.bounds(_matrix(part.column("v").to_pylist(), index.dim))
                may = high[0][:, cell // n_codes] + high[1][:, cell % n_codes] >= part.column("floor").to_numpy()[:, None]
                for b in np.unique(blocks):
                    go = np.flatnonzero(may[:, of[blocks == b]].any(axis=1))
                    if len(go):
                        some = part.take(pa.array(go))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), b, np.int32)), *[some.column(c) for c in _NAMES[1:]]], names=_NAMES)

    return queries.select(*_NAMES).mapInArrow(run, _ROW)


# ---------------------------------------------------------------- mining

def _floor_of(numerator: int, score: Column) -> Column:
    """The least score that ``numerator * score <= 100 * it`` allows; exact in whole numbers."""
    return -((-score * numerator - F.pmod(-score * numerator, F.lit(100))) / 100).cast("long")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         n_codes: int = N_CODES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` has ``id`` (long), ``label`` and ``v`` (integers, null for a row that takes no part);
    rows without id or label take no part.  Scores are integer inner products.  An anchor (a
    condition on ``id``) has its ``n_positives`` best other rows of its label as positives (all, if
    fewer); each positive brings the ``n_negatives`` best rows of other labels with
    ``low * positive <= 100 * negative <= high * positive`` (all, if fewer; none below a negative
    positive score).  Ties go to smaller ids.  Every row counts by itself: an id that repeats is
    several rows, each its own anchor.  Shorter vectors are filled up with zeros.
    """
    result = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    clean = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL") \
        .select(F.monotonically_increasing_id().alias("uid"), "id", F.col("label").cast("long").alias("label"), "v")
    placed, index, directory = build_index(materialize(clean, "vectors"), n_codes=n_codes, block_rows=block_rows)
    if index is None:
        return placed.limit(0).select(*[F.lit(0).cast("int" if c == "rank" else "long").alias(c) for c in result])
    placed = materialize(placed, "index")
    no_scores = F.lit(None).cast("array<long>").alias("scores")
    data = placed.select("block", F.lit(0).alias("kind"), "uid", "id", "label", "cell", "v", F.lit(NONE).alias("floor"), no_scores)
    anchors = placed.where(is_anchor).select("block", F.lit(1).alias("kind"), "uid", "id", "label", "cell", "v", F.lit(NONE).alias("floor"), no_scores)

    def batch_of(names: list[str], *cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def home(block, uid, label, q, up, down, floor, _):
        _, top = _positives(block, uid, label, q, up, down, floor, n_positives)
        return batch_of(["uid", "floor"], [uid], [int(top[-1]) if len(top) == n_positives else NONE])

    floors = _stream(data.unionByName(anchors), index, n_codes, "uid long, floor long", home)
    asked = materialize(anchors.drop("floor").join(floors, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE))), "floors")

    def best(block, uid, label, q, up, down, floor, _):
        ids, top = _positives(block, uid, label, q, up, down, floor, n_positives)
        return batch_of(["uid", "positive_id", "positive_score"], [uid] * len(ids), ids, top)

    found = _stream(data.unionByName(_spread(asked, index, directory, n_codes)), index, n_codes, "uid long, positive_id long, positive_score long", best)
    order = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
    positives = materialize(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives), "positives")

    # a search asks once for each distinct score: positives of one score share their window
    scores = positives.groupBy("uid").agg(F.collect_set("positive_score").alias("scores"), F.min("positive_score").alias("least"),
                                          F.max("positive_score").alias("most"))
    asked = anchors.drop("floor", "scores").join(scores.where("most >= 0"), "uid") \
        .withColumn("floor", _floor_of(low, F.greatest("least", F.lit(0).cast("long"))))

    def window(score: int) -> tuple[int, int]:
        return -(-low * score // 100), high * score // 100

    def hard(block, uid, label, q, up, down, _, scores):
        some = [s for s in scores if window(s)[0] <= window(s)[1]]
        got = _negatives(block, label, q, up, down, [window(s) for s in some], n_negatives) if some else []
        n = [len(ids) for ids, _ in got]
        return batch_of(["uid", "positive_score", "negative_id", "negative_score"], [uid] * sum(n), np.repeat(np.array(some, np.int64), n),
                        np.concatenate([ids for ids, _ in got]) if got else [], np.concatenate([s for _, s in got]) if got else [])

    hits = _stream(data.unionByName(_spread(asked, index, directory, n_codes)), index, n_codes,
                   "uid long, positive_score long, negative_id long, negative_score long", hard)
    order = Window.partitionBy("uid", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    names = placed.where(is_anchor).select("uid", F.col("id").alias("anchor_id"))
    return hits.join(positives, ["uid", "positive_score"]).join(names, "uid").select(*result)
