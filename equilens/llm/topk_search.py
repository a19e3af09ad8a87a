"""Exact top-k inner-product search with a pivot-distance index.

Vectors are lifted by one component so that all have the largest norm ``R``; for a query
lifted with 0, the squared distance is ``|q|^2 + R^2 - 2 q.x``, so the highest inner products
are the nearest vectors.  Every vector is keyed by its nearest pivot and its distance to it;
keys fall into annuli (pivot, distance range).  Annuli of one pivot and of neighbouring pivots
fill up a block together; a large annulus falls into several blocks by a hash of the id, so
equal vectors never crowd one task.

A search first scores each query inside its own block, which bounds its k-th best score from
below.  By the triangle inequality a vector whose pivot distance lies ``g`` away from the
query's is at least ``g`` away from the query; a query goes only to blocks that may hold
better scores.  Inside a block, rows sorted by pivot and distance to it are expanded strip by
strip from the query's own distance outwards, until no strip left can reach the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import materialize

N_PIVOTS, N_ANNULI, SAMPLE, BLOCK_ROWS, STRIP = 32, 4, 4096, 8192, 512
QUERY_BATCH = 1024


def quantize(embedding: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of each component as long; null where the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


# ---------------------------------------------------------------- geometry

def _matrix(rows: list, dim: int) -> np.ndarray:
    """Integer vectors as a matrix; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by floats where these hold every partial sum exactly."""
    top = float(max(np.abs(q).max(initial=0), 1)) * float(max(np.abs(x).max(initial=0), 1)) * max(q.shape[1], 1)
    if top < 2.0 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T                                    # scores must fit in a long


def _lift(x: np.ndarray, radius2: float) -> np.ndarray:
    f = x.astype(np.float64)
    return np.hstack([f, np.sqrt(np.maximum(radius2 - (f * f).sum(axis=1), 0.0))[:, None]])


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * a @ pivots.T, 0.0))


class Geometry:
    """Pivots and annulus edges, fitted on a bounded sample; every row is keyed by them."""

    def __init__(self, sample: np.ndarray, radius2: float, dim: int, n_pivots: int = N_PIVOTS, n_annuli: int = N_ANNULI):
        self.radius2, self.dim, self.n_annuli = radius2, dim, n_annuli
        x = _lift(sample, radius2)
        pick = [0]                                   # farthest-first, then a few rounds of means
        near = _distances(x, x[:1])[:, 0]
        while len(pick) < min(n_pivots, len(x)) and near.max() > 0:
            pick.append(int(near.argmax()))
            near = np.minimum(near, _distances(x, x[pick[-1:]])[:, 0])
        pivots = x[pick]
        for _ in range(5):
            own = _distances(x, pivots).argmin(axis=1)
            pivots = np.array([x[own == p].mean(axis=0) if (own == p).any() else pivots[p] for p in range(len(pivots))])
        self.pivots = pivots
        d = _distances(x, pivots)
        own = d.argmin(axis=1)
        at = np.arange(1, n_annuli) / n_annuli
        self.edges = np.array([np.quantile(d[own == p, p], at) if (own == p).any() else np.full(n_annuli - 1, np.inf)
                               for p in range(len(pivots))]).reshape(len(pivots), -1)

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell (pivot and annulus) and pivot distance of each row."""
        d = _distances(_lift(x, self.radius2), self.pivots)
        pivot = d.argmin(axis=1)
        dist = d[np.arange(len(x)), pivot]
        return pivot * self.n_annuli + (dist[:, None] > self.edges[pivot]).sum(axis=1), dist

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return _distances(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]), self.pivots)

    def ceiling(self, q: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Highest score that a vector at least ``gap`` away from each query can have, rounding included."""
        whole = (q.astype(np.float64) ** 2).sum(axis=1) + self.radius2
        whole = whole.reshape(-1, *[1] * (gap.ndim - 1))
        return (whole - gap * gap) / 2 + 1e-7 * whole + 1


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each row, ties to smaller ids; ``ids`` ascend."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.size and np.abs(scores).max() < 2 ** 62 // n:
        keyed = scores * n + np.arange(n - 1, -1, -1)
        at = np.argpartition(keyed, n - k, axis=1)[:, n - k:]
    else:
        at = np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, at, axis=1), ids[at]


NONE = np.iinfo(np.int64).min


def _strips(dist: np.ndarray, pivot: np.ndarray) -> list[np.ndarray]:
    """Rows of one pivot each, by distance to it, ``STRIP`` rows at most."""
    order = np.lexsort((dist, pivot))
    cuts = np.flatnonzero(np.diff(pivot[order])) + 1
    return [part[i:i + STRIP] for part in np.split(order, cuts) for i in range(0, len(part), STRIP)]


def _search_block(ids: np.ndarray, x: np.ndarray, dist: np.ndarray, cell: np.ndarray, geo: Geometry, q_ids: np.ndarray, q: np.ndarray,
                  floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates ``(query row, id, score)`` of a block at or above each query's bound, which strips raise."""
    strips = []
    for rows in _strips(dist, cell // geo.n_annuli):
        strips.append((dist[rows[0]], dist[rows[-1]], rows[np.argsort(ids[rows], kind="stable")]))
    low, high = np.array([s[0] for s in strips]), np.array([s[1] for s in strips])
    q_dist = geo.query_distances(q)[:, [cell[s[2][0]] // geo.n_annuli for s in strips]]
    gap = np.maximum(0.0, np.maximum(low[None, :] - q_dist, q_dist - high[None, :]))
    ceiling = geo.ceiling(q, gap)
    floor = floor.copy()
    out_q, out_id, out_s = [], [], []
    # annuli expand outwards from the queries: nearest strips first
    for s in np.argsort(gap.mean(axis=0), kind="stable"):
        go = np.flatnonzero(ceiling[:, s] >= floor)
        if not len(go):
            continue
        rows = strips[s][2]
        score = _products(q[go], x[rows])
        score[q_ids[go][:, None] == ids[rows][None, :]] = score.min() - 1
        top, who = _best(score, ids[rows], k)
        real = who != q_ids[go][:, None]
        if top.shape[1] == k:
            floor[go] = np.maximum(floor[go], np.where(real.all(axis=1), top.min(axis=1), NONE))
        r, c = np.nonzero(real & (top >= floor[go][:, None]))
        out_q.append(go[r])
        out_id.append(who[r, c])
        out_s.append(top[r, c])
    if not out_q:
        none = np.zeros(0, np.int64)
        return none, none, none
    row, who, score = map(np.concatenate, (out_q, out_id, out_s))
    order = np.lexsort((who, -score, row))
    row, who, score = row[order], who[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = place < k
    return row[keep], who[keep], score[keep]


# ---------------------------------------------------------------- index and search

def build_index(vectors: DataFrame, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Geometry | None, list]:
    """Index of ``(id, v)`` rows: ``id, v, dist, cell, block``; its geometry; and one directory entry for each cell.

    Pivots and edges are fitted on at most ``sample`` vectors, those of the smallest id
    hashes.  The directory has ``N_PIVOTS x N_ANNULI`` entries at most:
    ``(cell, rows, blocks, first block, least and greatest distance)``; cells that fit into one
    block together share its number.
    """
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = vectors.agg(F.max(norm).alias("r2"), F.max(F.size("v")).alias("dim")).first()
    if top["dim"] is None:
        return vectors.select("id", "v", F.lit(0.0).alias("dist"), F.lit(0).alias("cell"), F.lit(0).alias("block")), None, []
    dim = max(top["dim"], 1)
    picked = vectors.orderBy(F.xxhash64("id")).limit(sample).collect()
    geo = Geometry(_matrix([r["v"] for r in picked], dim), float(top["r2"]), dim)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, dist = geo.key(_matrix(batch.column("v").to_pylist(), dim))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(dist, pa.float64()),
                                                  pa.array(cell, pa.int32())], names=["id", "v", "dist", "cell"])

    keyed = materialize(vectors.select("id", "v").mapInArrow(key, "id long, v array<long>, dist double, cell int"), "keys")
    place = {p: i for i, p in enumerate(_chain(geo.pivots))}
    cells = sorted(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect(),
                   key=lambda c: (place[c["cell"] // geo.n_annuli], c["cell"]))
    directory, first, filled = [], 0, 0
    for c in cells:
        blocks = -(-c["n"] // block_rows)
        if filled and filled + c["n"] > block_rows:
            first, filled = first + 1, 0
        directory.append((c["cell"], c["n"], blocks, first, c["low"], c["high"]))
        if blocks > 1:
            first += blocks
        else:
            filled += c["n"]
    start = F.create_map(*[F.lit(x) for d in directory for x in (d[0], d[3])])
    count = F.create_map(*[F.lit(x) for d in directory for x in (d[0], d[2])])
    block = F.element_at(start, F.col("cell")) + F.pmod(F.xxhash64("id"), F.element_at(count, F.col("cell"))).cast("int")
    return keyed.select("id", "v", "dist", "cell", block.cast("int").alias("block")), geo, directory


def _chain(pivots: np.ndarray) -> list[int]:
    """Pivots in an order that goes from each to the nearest one left."""
    left, out = set(range(1, len(pivots))), [0]
    apart = _distances(pivots, pivots)
    while left:
        out.append(min(left, key=lambda p: (apart[out[-1], p], p)))
        left.remove(out[-1])
    return out


_ROW = "block int, id long, v array<long>, dist double, cell int, floor long, kind int"


def _stream(rows: DataFrame, geo: Geometry, k: int, floors_only: bool) -> DataFrame:
    """Score query rows (kind 1, after the data rows of their block) against the block's data rows."""
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
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("v").to_pylist(), geo.dim),
                                 part.column("dist").to_numpy(), part.column("cell").to_numpy()))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = tuple(np.concatenate(x) for x in zip(*held))
                for i in range(0, len(part), QUERY_BATCH):
                    p = part.slice(i, QUERY_BATCH)
                    q_ids, floor = p.column("id").to_numpy(), p.column("floor").to_numpy()
                    row, who, score = _search_block(*ready, geo, q_ids, _matrix(p.column("v").to_pylist(), geo.dim), floor, k)
                    if floors_only:                  # the k-th best score here, where there are k
                        full = np.bincount(row, minlength=len(p)) == k
                        last = np.full(len(p), np.iinfo(np.int64).max)
                        np.minimum.at(last, row, score)
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.where(full, last, NONE))],
                                                         names=["id", "floor"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(who), pa.array(score)],
                                                         names=["query_id", "vec_id", "score"])

    schema = "id long, floor long" if floors_only else "query_id long, vec_id long, score long"
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` best inner products over all other rows.

    ``vectors`` has ``id`` (long) and ``v`` (integers, null for a row that takes no part);
    ``is_query`` is a condition on ``id``.  Rows without an id take no part; an id that
    repeats is one row, with its smallest vector; shorter vectors are filled up with zeros.
    Ties go to smaller ids; with ``k`` or fewer other rows all are returned.
    """
    rows = vectors.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    index, geo, directory = build_index(materialize(rows, "vectors"))
    if geo is None:
        return index.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                            F.lit(0).cast("long").alias("score"))
    index = materialize(index, "index")
    data = index.select("block", "id", "v", "dist", "cell", F.lit(NONE).alias("floor"), F.lit(0).alias("kind"))
    queries = index.where(is_query)
    home = queries.select("block", "id", "v", "dist", "cell", F.lit(NONE).alias("floor"), F.lit(1).alias("kind"))
    floors = _stream(data.unionByName(home), geo, k, True)
    floors = queries.select("id", "v").join(floors, "id", "left").select("id", "v", F.coalesce("floor", F.lit(NONE)).alias("floor"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to every block that may hold a score at or above their bound."""
        cell = np.array([d[0] for d in directory])
        low, high = np.array([d[4] for d in directory]), np.array([d[5] for d in directory])
        parts: dict[int, list[int]] = {}
        for c, (_, _, blocks, first, _, _) in enumerate(directory):
            for b in range(first, first + blocks):
                parts.setdefault(b, []).append(c)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                q = _matrix(batch.column("v").to_pylist(), geo.dim)
                d = geo.query_distances(q)[:, cell // geo.n_annuli]
                gap = np.maximum(0.0, np.maximum(low - d, d - high))
                may = geo.ceiling(q, gap) >= batch.column("floor").to_numpy()[:, None]
                for b, held in parts.items():
                    go = np.flatnonzero(may[:, held].any(axis=1))
                    if len(go):
                        part, n = batch.take(pa.array(go)), len(go)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(n, b, np.int32)), part.column("id"), part.column("v"), pa.array(np.zeros(n)),
                            pa.array(np.zeros(n, np.int32)), part.column("floor"), pa.array(np.ones(n, np.int32))],
                            names=["block", "id", "v", "dist", "cell", "floor", "kind"])

    found = _stream(data.unionByName(materialize(floors, "floors").mapInArrow(spread, _ROW)), geo, k, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
