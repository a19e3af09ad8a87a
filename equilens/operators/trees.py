"""Decision tree, random forest and boosted trees as passes over blocks of cells (:mod:`cells`).

A pass adds up the labels by node and cell; the best splits follow from the sums.  The choices are the library's: Gini or
variance gain, the first of equal splits in the order of the features, no split without gain, two leaves that say the same
made one.  The sums of the forest and of the single tree are added up and searched in the tasks, only splits reach the driver.

The single tree has no bound but the depth of 30 that the library allows, and so about as many nodes as rows.  Only its
top, nodes of more than ``LOCAL_ROWS`` rows, is grown by passes and kept on the driver.  Below, rows are shuffled by
node, and one task grows a node's subtree, scores the rows to be scored there and drops it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators import cells as cl
from equilens.operators.sizing import written
from equilens.spec import AuditSpec

LOCAL_ROWS = 20_000           # train rows of a node whose subtree one task grows, at most
CHUNK_NODES = 1_000           # nodes whose sums are searched at once
MARK_LEVELS = 4               # levels of a forest between two notes of the rows' nodes
ONES = 2.0 ** 26              # drawn rows of a task are fewer; sums of both labels share a double
SEED = 0


# ---- nodes and splits ---------------------------------------------------------------------
class Nodes:
    """Nodes in the order they came, children after their parent and side by side; ``split`` -1 is a leaf."""

    def __init__(self, stats: np.ndarray):
        self.split, self.left = np.array([-1]), np.array([0])
        self.stats, self.levels = stats.reshape(1, -1), [0]

    def add(self, at: np.ndarray, split: np.ndarray, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Splits the leaves ``at``; returns the first child of each."""
        n = len(self.split)
        first = n + 2 * np.arange(len(at))
        self.split[at], self.left[at] = split, first
        self.levels.append(n)
        self.split = np.concatenate([self.split, np.full(2 * len(at), -1)])
        self.left = np.concatenate([self.left, np.zeros(2 * len(at), int)])
        children = np.stack([left, total - left], axis=1).reshape(-1, left.shape[1])
        self.stats = np.concatenate([self.stats, children])
        return first

    def prune(self, keep: np.ndarray | None = None, says: np.ndarray | None = None):
        """Makes a node a leaf where both children are leaves that say the same; those in ``keep`` are no leaves."""
        says = self.says() if says is None else says
        ends = [*self.levels[1:], len(self.split)]
        for a, b in reversed(list(zip(self.levels, ends))):
            inner = a + np.flatnonzero(self.split[a:b] >= 0)
            kid = self.left[inner]
            same = (self.split[kid] < 0) & (self.split[kid + 1] < 0) & (says[kid] == says[kid + 1])
            if keep is not None:
                same &= ~keep[kid] & ~keep[kid + 1]
            self.split[inner[same]] = -1

    def says(self) -> np.ndarray:
        return (self.stats[:, 1] > self.stats[:, 0]).astype(np.int8)

    def route(self, cells: cl.Cells, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node = np.zeros(x.shape[1], np.int64)
        live = np.arange(x.shape[1])
        while live.size:
            s = self.split[node[live]]
            inner = s >= 0
            if not inner.all():
                live, s = live[inner], s[inner]
            node[live] = self.left[node[live]] + cells.right(s, x, live)
        return node


class Router:
    """A tree as tables by node, for many steps of many rows; a leaf goes to itself."""

    def __init__(self, nodes: Nodes, cells: cl.Cells):
        inner, split = nodes.split >= 0, np.maximum(nodes.split, 0)
        take = lambda a: a[split] if len(a) else np.zeros(len(split), np.int64)
        self.column = np.where(inner, take(cells.column), 0)
        # a row goes to the right where its cell less ``low`` is at most ``span``, in numbers that wrap around
        self.low = np.where(inner, take(cells.low), np.iinfo(cells.dtype).max).astype(cells.dtype)
        self.span = np.where(inner, take(cells.high) - take(cells.low), 0).astype(cells.dtype)
        self.kid = np.where(inner, nodes.left, np.arange(len(inner)))

    def step(self, flat: np.ndarray, n: int, rows: np.ndarray, node: np.ndarray, times: int) -> np.ndarray:
        """Nodes of ``rows`` ``times`` levels below ``node``; ``flat`` holds the cells of ``n`` rows column by column."""
        for _ in range(times):
            cell = flat[self.column[node] * n + rows]
            node = self.kid[node] + (cell - self.low[node] <= self.span[node])
        return node


def gini_gain(left: np.ndarray, total: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Gain of every split from weights by label ``(nodes, splits, 2)`` and ``(nodes, 2)``; -inf where a side is empty.

    ``level`` marks the splits by a level: there the library takes off the side with fewer ones first, so that it
    rounds equal gains of two splits in the same way.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        def gini(a, b, n):
            f, g = a / n, b / n
            return 1.0 - f * f - g * g
        n = (total[:, 0] + total[:, 1])[:, None]
        l0, l1 = left[..., 0], left[..., 1]
        r0, r1 = total[:, None, 0] - l0, total[:, None, 1] - l1
        ln, rn = l0 + l1, r0 + r1
        a, b = ln / n * gini(l0, l1, ln), rn / n * gini(r0, r1, rn)
        turned = level & (r1 < l1)
        gain = gini(total[:, :1], total[:, 1:], n) - np.where(turned, b, a) - np.where(turned, a, b)
        return np.where((ln > 0) & (rn > 0), gain, -np.inf)


def variance_gain(left: np.ndarray, total: np.ndarray, _level: np.ndarray) -> np.ndarray:
    """As :func:`gini_gain`, from counts and sums."""
    with np.errstate(divide="ignore", invalid="ignore"):
        n, s = total[:, :1], total[:, 1:]
        ln, ls = left[..., 0], left[..., 1]
        rn, rs = n - ln, s - ls
        gain = (ls * ls / ln + rs * rs / rn - s * s / n) / n
        return np.where((ln > 0) & (rn > 0), gain, -np.inf)


def best_splits(cells: cl.Cells, hist: np.ndarray, gain, allowed: np.ndarray | None = None, totals_known: np.ndarray | None = None):
    """Best split of each node (-1 where none gains), the sums left of it and of the node."""
    split, lefts, totals = [], [], []
    for a in range(0, len(hist), CHUNK_NODES):
        left, total = cells.sides(hist[a:a + CHUNK_NODES], None if totals_known is None else totals_known[a:a + CHUNK_NODES])
        if left.shape[1]:
            g = gain(left, total, cells.by_level)
            if allowed is not None:
                g = np.where(allowed[a:a + CHUNK_NODES][:, cells.feature], g, -np.inf)
            best, at = np.argmax(g, axis=1), np.arange(len(g))
            split.append(np.where(g[at, best] > 0, best, -1))
            lefts.append(left[at, best])
        else:
            split.append(np.full(len(total), -1))
            lefts.append(total)
        totals.append(total)
    return np.concatenate(split), np.concatenate(lefts), np.concatenate(totals)


def _by_label(x: np.ndarray, y: np.ndarray, node: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Rows by node, cell and label."""
    out = np.zeros(nodes * width * 2)
    base = node * (2 * width) + y
    for column in x:
        out += np.bincount(base + 2 * column.astype(np.int64), minlength=len(out))
    return out.reshape(nodes, width, 2)


# ---- single tree --------------------------------------------------------------------------
def grow(cells: cl.Cells, x: np.ndarray, y: np.ndarray, depth: int) -> Nodes:
    """The tree of a bounded number of rows, level by level."""
    y = y.astype(np.int64)
    nodes = Nodes(np.bincount(y, minlength=2).astype(float))
    active = np.flatnonzero(nodes.stats.min(axis=1) > 0)
    rows, place = np.arange(len(y)), np.zeros(len(y), np.int64)     # rows in active nodes, in the order of these
    for _ in range(depth):
        if not len(active):
            break
        found = []
        for a in range(0, len(active), CHUNK_NODES):
            b = min(a + CHUNK_NODES, len(active))
            r = slice(*np.searchsorted(place, [a, b]))
            hist = _by_label(x[:, rows[r]], y[rows[r]], place[r] - a, b - a, cells.width)
            found.append(best_splits(cells, hist, gini_gain))
        split, left, total = (np.concatenate(f) for f in zip(*found))
        ok = split >= 0
        first = np.zeros(len(active), np.int64)
        first[ok] = nodes.add(active[ok], split[ok], left[ok], total[ok])
        new = np.arange(nodes.levels[-1], len(nodes.split))
        mixed = nodes.stats[new].min(axis=1) > 0
        rows, place = rows[ok[place]], place[ok[place]]
        child = first[place] + cells.right(split[place], x, rows) - nodes.levels[-1]
        rows, child = rows[mixed[child]], child[mixed[child]]
        active = new[mixed]
        place = (np.cumsum(mixed) - 1)[child]
        order = np.argsort(place, kind="stable")
        rows, place = rows[order], place[order]
    nodes.prune()
    return nodes


def _grow_top(rows, cells: cl.Cells, depth: int):
    """Top of the tree, which of its leaves go on in a task, and the depth of each node."""
    def totals(blocks):
        yield np.sum([np.bincount(y, minlength=2) for _, _, y in blocks] or [np.zeros(2)], axis=0)

    nodes = Nodes(rows.mapPartitions(totals).treeReduce(np.add).astype(float))
    level, new = np.zeros(1, int), np.array([0])
    for d in range(depth):
        active = new[(nodes.stats[new].min(axis=1) > 0) & (nodes.stats[new].sum(axis=1) > LOCAL_ROWS)]
        if not len(active):
            break

        def sums(blocks, nodes=nodes, active=active):
            place = np.full(len(nodes.split), -1)
            place[active] = np.arange(len(active))
            held = {}
            for _, x, y in blocks:
                at = place[nodes.route(cells, x)]
                order = np.argsort(at, kind="stable")
                chunk = at[order] // CHUNK_NODES
                for c in np.unique(chunk[at[order] >= 0]):
                    r = order[chunk == c]
                    size = min(CHUNK_NODES, len(active) - c * CHUNK_NODES)
                    got = _by_label(x[:, r], y[r].astype(np.int64), at[r] - c * CHUNK_NODES, size, cells.width)
                    held[c] = held[c] + got if c in held else got
            yield from ((int(c), h) for c, h in held.items())

        parts = min(rows.getNumPartitions(), -(-len(active) // CHUNK_NODES))
        got = dict(rows.mapPartitions(sums).reduceByKey(np.add, parts).mapValues(lambda h: best_splits(cells, h, gini_gain)).collect())
        split, left, total = (np.concatenate(f) for f in zip(*[got[c] for c in sorted(got)]))
        ok = split >= 0
        nodes.add(active[ok], split[ok], left[ok], total[ok])
        new = np.arange(nodes.levels[-1], len(nodes.split))
        level = np.concatenate([level, np.full(len(new), d + 1)])
    size = nodes.stats.sum(axis=1)
    local = (nodes.split < 0) & (nodes.stats.min(axis=1) > 0) & (size <= LOCAL_ROWS) & (level < depth)
    return nodes, local, level


def tree_fit_score(train: DataFrame, test: DataFrame, spec: AuditSpec, depth: int, label: str = "label_Y", keep=()) -> DataFrame:
    """Scores of ``test`` by the decision tree of ``train``, in the layout of :func:`models.score`."""
    cells, n, _ = cl.learn(train, spec, label)
    top, local, level = _grow_top(cl.blocks(train, cells, n, label), cells, depth)
    own = [*keep, label, *spec.protected]
    types = [test.schema[c].dataType for c in own]
    kept = [f"k{i}" for i in range(len(own))]
    learnt = cells.rows(train, label, [F.lit(None).cast(t).alias(k) for k, t in zip(kept, types)])
    asked = cells.rows(test, keep=[*[F.col(c).alias(k) for k, c in zip(kept, own)], F.lit(None).cast("byte").alias("y")])
    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in zip(kept, types))
    width = np.dtype(cells.dtype).itemsize * len(cells.sizes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = cells.encode(batch)
            node = top.route(cells, x)
            packed = pa.Array.from_buffers(pa.binary(width), batch.num_rows, [None, pa.py_buffer(x.T.tobytes())])
            out = pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], batch.column("y"), pa.array(node, pa.int64()), packed.cast(pa.binary())],
                                             names=[*kept, "y", "node", "x"])
            yield out.filter(pa.array(local[node] | (np.asarray(batch.column("y").is_null()))))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, held = -1, None, []

        def grown():
            if not held:
                return None
            x, y = (np.concatenate(a, axis=-1) for a in zip(*held))
            return grow(cells, x, y, depth - int(level[at]))

        def one_leaf():
            """A row of the node itself, with what its subtree says, where that is one leaf."""
            if tree is not None and tree.split[0] < 0:
                none = [pa.nulls(1, batch.schema.field(k).type) for k in kept]
                yield pa.RecordBatch.from_arrays([*none, pa.array([at], pa.int64()), pa.array([None], pa.float64()),
                                                  pa.array([int(tree.says()[0])], pa.int32())], names=[*kept, "node", "p", "says"])
        for batch in batches:
            node = batch.column("node").to_numpy()
            edges = [0, *(1 + np.flatnonzero(np.diff(node))), len(node)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if node[a] != at:
                    if held:                                   # a node without rows to score
                        tree, held = grown(), []
                        yield from one_leaf()
                    at, tree = int(node[a]), None
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), cells.dtype).reshape(b - a, -1).T
                asks = np.asarray(part.column("y").is_null())
                if not asks.all():
                    held.append((x[:, ~asks], part.column("y").drop_null().to_numpy()))
                if asks.any():
                    if held:
                        tree, held = grown(), []
                        yield from one_leaf()
                    p = pa.nulls(int(asks.sum()), pa.float64())
                    if tree is not None:
                        s = tree.stats[tree.route(cells, x[:, asks])]
                        p = pa.array(s[:, 1] / s.sum(axis=1))
                    rows = part.filter(pa.array(asks))
                    yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in kept], rows.column("node"), p, pa.nulls(len(p), pa.int32())],
                                                     names=[*kept, "node", "p", "says"])
        if held:
            tree, held = grown(), []
            yield from one_leaf()

    spark = train.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / cl.TASK_ROWS))
    both = learnt.unionByName(asked).mapInArrow(assign, f"{schema}, y byte, node long, x binary")
    both = both.repartition(parts, "node").sortWithinPartitions("node", F.col("y").asc_nulls_last())
    done = written(both.mapInArrow(finish, f"{schema}, node long, p double, says int"), "tree")
    return _finished(done, top, local, kept, own, len(keep))


def _finished(done: DataFrame, top: Nodes, local: np.ndarray, kept, own, n_keep: int) -> DataFrame:
    """Scores of the rows in leaves of the top; subtrees of one leaf may make leaves of the nodes above."""
    says, open_ = top.says(), local.copy()
    for r in done.where("says IS NOT NULL").select("node", "says").collect():
        says[r["node"]], open_[r["node"]] = r["says"], False
    top.prune(open_, says)
    final = np.arange(len(top.split))                          # the leaf that each node of the tree grown fell to
    for a, b in zip(top.levels, [*top.levels[1:], len(top.split)]):
        inner = a + np.flatnonzero(top.left[a:b] > 0)
        for side in (0, 1):
            kid = top.left[inner] + side
            fell = (top.split[inner] < 0) | (final[inner] != inner)
            final[kid[fell]] = final[inner[fell]]
    leaves = np.flatnonzero((top.left == 0) & ~open_)
    s = top.stats[final[leaves]]
    with np.errstate(invalid="ignore"):
        p = s[:, 1] / s.sum(axis=1)
    table = done.sparkSession.createDataFrame([(int(k), float(v)) for k, v in zip(leaves, p)], "node long, q double")
    out = done.where("says IS NULL").join(F.broadcast(table), "node", "left").withColumn("s", F.coalesce("q", "p"))
    names = [F.col(k).alias(c) for k, c in zip(kept, own)]
    return out.select(*names[:n_keep], F.col(kept[n_keep]).cast("int").alias("label_Y"), (F.col("s") > 0.5).cast("int").alias("pred_Y"),
                      F.col("s").alias("score_S"), *names[n_keep + 1:])


# ---- random forest ------------------------------------------------------------------------
@cache
def _poisson_table() -> np.ndarray:
    """How often a row is drawn (Poisson, mean 1), for each of 65,536 equally likely numbers."""
    p = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(p, (np.arange(65_536) + 0.5) / 65_536).astype(np.int8)


def _drawn(tree: int, block: int, n: int) -> np.ndarray:
    return _poisson_table()[np.random.default_rng([SEED, tree, block]).integers(0, 65_536, n, np.uint16)]


def _offered(tree: int, level: int, nodes: int, n_features: int, take: int) -> np.ndarray:
    """Features that each node of a tree's level may split by, drawn without replacement."""
    r = np.random.default_rng([SEED, tree, level, 1]).random((nodes, n_features), np.float32)
    out = np.zeros((nodes, n_features), bool)
    if n_features:
        np.put_along_axis(out, np.argpartition(r, take - 1, axis=1)[:, :take], True, axis=1)
    return out


def _offered_cells(cells: cl.Cells, offered: np.ndarray) -> np.ndarray:
    """Place of each node's offered cells in its tree's sums, by node and cell; -1: not summed."""
    ok = offered[:, cells.cell_feature] & (cells.cell_feature >= 0)
    return np.where(ok, np.cumsum(ok.ravel()).reshape(ok.shape) - 1, -1).astype(np.int32)


def fit_forest(train: DataFrame, spec: AuditSpec, n_trees: int, depth: int, label: str = "label_Y", take: int | None = None, bag: bool = True):
    """Cells and the trees.  Each node may split by the square root of the number of features (or ``take``)."""
    cells, n, _ = cl.learn(train, spec, label)
    rows = cl.blocks(train, cells, n, label)
    take = take or max(math.ceil(math.sqrt(cells.n_features)), 1)

    def drawn(t: int, block: int, n: int):
        w = _drawn(t, block, n) if bag else np.ones(n, np.int8)
        at = np.flatnonzero(w)
        return at, w[at]

    def marked(trees: dict, marks: dict, steps: int):
        """The block with the place of each drawn row among the active nodes of its tree, instead of those ``marks`` names."""
        tables = {t: (Router(nodes, cells), _places(nodes, active)) for t, (nodes, active) in trees.items()}

        def run(b):
            block, x, y, held = b
            flat, out = np.ascontiguousarray(x).ravel(), {}
            for t, (router, place) in tables.items():
                at, _ = drawn(t, block, len(y))
                now = place[router.step(flat, len(y), at, _start(marks, held, t, at), steps)]
                active = len(trees[t][1])
                out[t] = np.where(now < 0, active, now).astype(np.min_scalar_type(active))
            return block, x, y, out
        return run

    def sums(trees: dict, level: int, marks: dict, steps: int):
        """For each tree, rows by its active nodes' offered cells and label, then by node and label."""
        def run(blocks):
            held, by_label = list(blocks), np.array([1.0, ONES + 1.0])     # a bounded number of packed rows
            for t, (nodes, active) in trees.items():
                router, place = Router(nodes, cells), _places(nodes, active)
                offered = _offered(t, level, len(active), cells.n_features, take)
                spot = _offered_cells(cells, offered)
                size = int(spot.max(initial=-1)) + 1
                where, weight, flat_spot = [], [], spot.ravel()
                numbers = [np.ascontiguousarray(offered[:, j]) for j in range(len(cells.cuts))]
                for block, x, y, kept in held:
                    at, w = drawn(t, block, len(y))
                    now = place[router.step(np.ascontiguousarray(x).ravel(), len(y), at, _start(marks, kept, t, at), steps)]
                    if now.min(initial=0) < 0:
                        use = np.flatnonzero(now >= 0)
                        at, w, now = at[use], w[use], now[use]
                    w = w * by_label[y[at]]                    # rows, and rows with label 1 in the upper bits
                    where.append(size + now)
                    weight.append(w)
                    base = now * cells.width
                    for j, column in enumerate(x):
                        if j < len(cells.cuts) and len(cells.cuts[j]):
                            hit = np.flatnonzero(numbers[j][now])
                            k = flat_spot[base[hit] + column[at[hit]]]
                        else:
                            k = flat_spot[base + column[at]]
                            hit = np.flatnonzero(k >= 0)
                            k = k[hit]
                        where.append(k)
                        weight.append(w[hit])
                out = np.zeros(size + len(active))
                if where:
                    out += np.bincount(np.concatenate(where), weights=np.concatenate(weight), minlength=len(out))
                ones = np.floor(out / ONES)
                yield t, np.stack([out - ones * (ONES + 1.0), ones], axis=1).astype(np.uint32)
        return run

    def search(trees: dict, level: int):
        def run(item):
            t, got = item
            n_active = len(trees[t][1])
            offered = _offered(t, level, n_active, cells.n_features, take)
            spot = _offered_cells(cells, offered)
            hist = np.zeros((n_active, cells.width, 2))
            hist[spot >= 0] = got[:len(got) - n_active]
            return t, best_splits(cells, hist, gini_gain, offered, got[len(got) - n_active:].astype(float))
        return run

    return cells, _grow_forest(rows, n_trees, depth, marked, sums, search)


def _places(nodes: Nodes, active: np.ndarray) -> np.ndarray:
    place = np.full(len(nodes.split), -1)
    place[active] = np.arange(len(active))
    return place


def _start(marks: dict, held: dict, t: int, at: np.ndarray) -> np.ndarray:
    """Node of each drawn row at the last mark; the root without one."""
    return marks[t][held[t]] if t in marks else np.zeros(len(at), np.int64)


def _grow_forest(rows, n_trees: int, depth: int, marked, sums, search) -> list:
    """All trees level by level, one pass for each level; a tree's sums are searched in one task.

    A pass finds each row's node from the last mark: every ``MARK_LEVELS`` levels the blocks are kept with the rows' places.
    """
    forest = [Nodes(np.zeros(2)) for _ in range(n_trees)]
    active = {t: np.array([0]) for t in range(n_trees)}
    parts = min(n_trees, max(rows.getNumPartitions(), 1))
    state, marks, last, kept, before = rows.map(lambda b: (*b, {})), {}, 0, None, None
    for level in range(depth):
        if not active:
            break
        trees = {t: (forest[t], a) for t, a in active.items()}
        if level % MARK_LEVELS == MARK_LEVELS - 1 and level < depth - 1:
            before, kept = kept, state.map(marked(trees, marks, level - last)).persist(StorageLevel.MEMORY_AND_DISK)
            # rows in leaves have the place after the last node, whose mark is the root of no active node
            state, marks, last = kept, {t: np.append(a, _leaf(forest[t], a)) for t, a in active.items()}, level
        got = state.mapPartitions(sums(trees, level, marks, level - last)).reduceByKey(np.add, parts).map(search(trees, level)).collect()
        if before is not None:
            before.unpersist()
            before = None
        for t, (split, left, total) in got:
            nodes, at, ok = forest[t], active.pop(t), split >= 0
            nodes.stats[at] = total
            nodes.add(at[ok], split[ok], left[ok], total[ok])
            new = np.arange(nodes.levels[-1], len(nodes.split))
            new = new[nodes.stats[new].min(axis=1) > 0]
            if len(new):
                active[t] = new
    if kept is not None:
        kept.unpersist()
    for nodes in forest:
        nodes.prune()
    return forest


def _leaf(nodes: Nodes, active: np.ndarray) -> int:
    """A node that will never be split, -1 (which no row has then) where there is none."""
    leaves = np.setdiff1d(np.flatnonzero(nodes.split < 0), active)
    return int(leaves[0]) if len(leaves) else -1


def score_forest(model, df: DataFrame, spec: AuditSpec, label: str = "label_Y", keep=()) -> DataFrame:
    """Every tree gives the label shares of the row's leaf; the score is their mean."""
    cells, forest = model
    trees = []
    for nodes in forest:
        if nodes.stats[0].sum() > 0:
            with np.errstate(invalid="ignore"):
                trees.append((Router(nodes, cells), len(nodes.levels) - 1, nodes.stats / nodes.stats.sum(axis=1, keepdims=True)))

    def predict(x):
        votes, flat, rows = np.zeros((x.shape[1], 2)), np.ascontiguousarray(x).ravel(), np.arange(x.shape[1])
        for router, depth, shares in trees:
            votes += shares[router.step(flat, len(rows), rows, np.zeros(len(rows), np.int64), depth)]
        return (votes[:, 1] > votes[:, 0]).astype(np.int32), votes[:, 1] / votes.sum(axis=1)
    return cl.scored(df, cells, spec, label, keep, predict)


# ---- boosted trees ------------------------------------------------------------------------
def fit_boosted(train: DataFrame, spec: AuditSpec, rounds: int, depth: int, step: float, label: str = "label_Y"):
    """Cells and ``(nodes, value of each node)`` of the trees: logistic loss, the first tree fits the labels -1 and 1.

    The blocks are kept with each row's sum so far, which a map renews after each tree.
    """
    cells, n, _ = cl.learn(train, spec, label)
    state = cl.blocks(train, cells, n, label).map(lambda b: (b[1], 2.0 * b[2] - 1.0, np.zeros(len(b[2]))))
    state, before, model = state.persist(StorageLevel.MEMORY_AND_DISK), None, []
    for m in range(rounds):
        nodes, active = Nodes(np.zeros(2)), np.array([0])
        for level in range(depth):
            if not len(active):
                break
            hist = state.mapPartitions(_residual_sums(cells, nodes, active, m == 0)).treeReduce(np.add)
            if before is not None:
                before.unpersist()
                before = None
            split, left, total = best_splits(cells, hist, variance_gain)
            ok = split >= 0
            nodes.stats[active] = total
            nodes.add(active[ok], split[ok], left[ok], total[ok])
            active = np.arange(nodes.levels[-1], len(nodes.split))
        value = nodes.stats[:, 1] / np.maximum(nodes.stats[:, 0], 1) * (step if m else 1.0)
        model.append((nodes, value))
        before, state = state, state.map(_added(cells, nodes, value)).persist(StorageLevel.MEMORY_AND_DISK)
    if before is not None:
        before.unpersist()
    state.unpersist()
    return cells, model


def _residual_sums(cells: cl.Cells, nodes: Nodes, active: np.ndarray, first: bool):
    """Rows and residuals by active node and cell."""
    def run(blocks):
        place = np.full(len(nodes.split), -1)
        place[active] = np.arange(len(active))
        size = len(active) * cells.width
        out = np.zeros((2, size))
        for x, y, so_far in blocks:
            with np.errstate(over="ignore"):
                r = y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * so_far))
            at = place[nodes.route(cells, x)]
            if at.min(initial=0) < 0:
                use = at >= 0
                at, x, r = at[use], x[:, use], r[use]
            at = at * cells.width
            for column in x:
                k = at + column
                out[0] += np.bincount(k, minlength=size)
                out[1] += np.bincount(k, weights=r, minlength=size)
        yield out.T.reshape(len(active), cells.width, 2)
    return run


def _added(cells: cl.Cells, nodes: Nodes, value: np.ndarray):
    return lambda b: (b[0], b[1], b[2] + value[nodes.route(cells, b[0])])


def score_boosted(model, df: DataFrame, spec: AuditSpec, label: str = "label_Y", keep=()) -> DataFrame:
    """P(y=1) = 1 / (1 + exp(-2 sum of the trees))."""
    cells, trees = model

    def predict(x):
        f = np.zeros(x.shape[1])
        for nodes, value in trees:
            f += value[nodes.route(cells, x)]
        with np.errstate(over="ignore"):
            return (f > 0).astype(np.int32), 1.0 / (1.0 + np.exp(-2.0 * f))
    return cl.scored(df, cells, spec, label, keep, predict)
