"""Accuracy of a linear model after one feature is permuted, for many permutations, from packed rows.

What a row adds to the score by each feature is one number, so a permuted row is its score without the feature
plus that number of the row whose value it takes.  A permutation is that of :func:`importance.permutation_importance`:
along the order of a content hash every row takes the value of the next.  The leading 64 bits of the hash are the order.

A pass exchanges for some permutations a few packed arrays from each block of rows to each slice of the hash (about 20 bytes
a row and permutation); its files are freed before the next pass, so the disk holds a few passes, not all permutations.
"""

from __future__ import annotations

import gc
import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators.sizing import written

BLOCK_ROWS = 16_384
SLICE_ROWS = 1_000_000        # rows of one permutation that a task orders at once, about
PASS_ROWS = 25_000_000        # rows times permutations that are exchanged before their files are freed, about


def free_shuffles(spark) -> None:
    """Lets Spark remove the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _small(v: np.ndarray):
    """Distinct numbers and a byte for each row where they are few, else the numbers as they are."""
    values, at = np.unique(v, return_inverse=True)
    return (values, at.astype(np.uint8)) if len(values) <= 256 else (v, None)


def _full(values: np.ndarray, at) -> np.ndarray:
    return values if at is None else values[at]


def _blocks(test: DataFrame, added: dict, content, label: str) -> RDD:
    """``(contents, labels, copies, what each feature adds)`` of blocks of distinct rows, from a table written once.

    Labels are 0, 1, 2 for any other and -1 for null; ``copies`` is None where all rows are distinct.
    """
    columns = [F.col(c).cast("string" if isinstance(by, dict) else "double").alias(f"x{i}") for i, (c, by) in enumerate(added.items())]
    y = F.when(F.col(label).isNull(), -1).when(F.col(label).cast("double").isin(0.0, 1.0), F.col(label).cast("int")).otherwise(2)
    rows = test.select(content.alias("t"), y.cast("byte").alias("y"), *columns)

    def adds(column: pa.Array, by) -> np.ndarray:
        if not isinstance(by, dict):
            return by * np.asarray(column.to_numpy(zero_copy_only=False), float)
        d = column.dictionary_encode()
        table = np.array([by.get(v, 0.0) for v in d.dictionary.to_pylist()] + [0.0])
        return table[d.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def packed():
            t = pa.Table.from_batches(held)
            t = t.group_by(t.column_names, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            copies = t.column("count_all").to_numpy()
            v = [_small(adds(t.column(f"x{i}").combine_chunks(), by)) for i, by in enumerate(added.values())]
            texts = [x.encode() for x in t.column("t").to_pylist()]
            block = (texts, t.column("y").to_numpy().astype(np.int8), copies if (copies > 1).any() else None, v)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["b"])
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield packed()
                held, count = [], 0
        if count:
            yield packed()

    # every row is hashed once for each permutation: spread over all tasks, however few files hold them
    tasks = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.mapInArrow(pack, "b binary").repartition(tasks), "tests").rdd.map(lambda r: pickle.loads(bytes(r["b"])))


def _hits(score: np.ndarray, y: np.ndarray, copies) -> tuple:
    """Rows that are predicted right, and rows with a label."""
    hit, known = np.where(score > 0, y == 1, y == 0), y >= 0
    return (int(hit.sum()), int(known.sum())) if copies is None else (int(copies[hit].sum()), int(copies[known].sum()))


def _ordered(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Order by hash, and by number where hashes are equal."""
    order = np.argsort(h)
    return order if np.diff(h[order]).all() else np.lexsort((c, h))


def _base(intercept: float):
    def run(blocks):
        n, hits, known = 0, 0, 0
        for _, y, copies, v in blocks:
            h, k = _hits(intercept + sum(_full(*x) for x in v), y, copies)
            n, hits, known = n + len(y), hits + h, known + k
        yield np.array([n, hits, known])
    return run


def _ask(variants: list, slices: int, intercept: float, seed: int):
    """``(variant and slice, rows of a block there and what comes next in the block)``; variants are (feature's place, name, repeat)."""
    def run(blocks):
        for texts, y, copies, v in blocks:
            full = [_full(*x) for x in v]
            for at, (j, f, r) in enumerate(variants):
                suffix = f":{f}:{r}:{seed}".encode()
                digests = b"".join([hashlib.md5(t + suffix).digest() for t in texts])
                h = np.frombuffer(digests, ">u8")[::2].astype(np.uint64)
                rest = intercept + sum((x for i, x in enumerate(full) if i != j), np.zeros(len(h)))
                order = _ordered(h, full[j])
                h, rest, c, ys = h[order], rest[order], full[j][order], y[order]
                k = None if copies is None else copies[order]
                few = None if v[j][1] is None else v[j][1][order]
                s = ((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
                edges = np.searchsorted(s, np.arange(slices + 1).astype(np.uint64))
                filled = np.flatnonzero(np.diff(edges))
                after = np.searchsorted(filled, np.arange(slices), side="right")       # the next filled slice; past the last, the first
                for i in range(slices):
                    a, b, to = edges[i], edges[i + 1], int(filled[after[i] % len(filled)])
                    head = ((to - i - 1) % slices, int(h[edges[to]]), float(c[edges[to]]))
                    yield at * slices + i, (h[a:b], rest[a:b], ys[a:b], None if k is None else k[a:b], (c[a:b], None) if few is None else (v[j][0], few[a:b]), head)
    return run


def _answer(slices: int):
    """``(variant, right rows, rows with a label)`` of each slice."""
    def run(items):
        held: dict = {}
        for key, got in items:
            held.setdefault(key, []).append(got)
        for key, got in held.items():
            # the least in the order of the slices to come: not-a-number is the last of equal hashes
            head = min((g[5] for g in got), key=lambda x: (x[0], x[1], math.isnan(x[2]), x[2]))[2]
            h, rest, y = (np.concatenate([g[i] for g in got]) for i in range(3))
            if not len(h):
                continue
            copies = None if all(g[3] is None for g in got) else np.concatenate([np.ones(len(g[0]), np.int64) if g[3] is None else g[3] for g in got])
            c = np.concatenate([_full(*g[4]) for g in got])
            order = _ordered(h, c)
            starts = np.concatenate([[0], 1 + np.flatnonzero(np.diff(h[order]))])
            after = np.append(c[order][starts[1:]], head)
            score = rest[order] + np.repeat(after, np.diff(np.append(starts, len(h))))
            yield key // slices, *_hits(score, y[order], None if copies is None else copies[order])
    return run


def accuracies(terms: tuple, test: DataFrame, feats: list, content, label: str, repeats: int, seed: int):
    """Accuracy of the rows as they are, and ``{feature: accuracies of its permutations}``; None without rows.

    ``terms`` is what :func:`models.linear_terms` gives.
    """
    intercept, added = terms
    spark, place = test.sparkSession, {c: i for i, c in enumerate(added)}
    free_shuffles(spark)
    rows = _blocks(test, added, content, label)
    free_shuffles(spark)
    n, hits, known = rows.mapPartitions(_base(intercept)).treeReduce(np.add)
    if not n:
        return None
    share = lambda a, b: float(a / b) if b else None
    variants = [(place[f], f, r) for f in feats for r in range(repeats)]
    slices, step = math.ceil(n / SLICE_ROWS), max(1, PASS_ROWS // int(n))
    found: dict = {f: [] for f in feats}
    for a in range(0, len(variants), step):
        some = variants[a:a + step]
        asked = rows.mapPartitions(_ask(some, slices, intercept, seed)).partitionBy(len(some) * slices, int)
        sums = np.zeros((len(some), 2), np.int64)
        for at, h, k in asked.mapPartitions(_answer(slices)).collect():
            sums[at] += (h, k)
        for (_, f, _), (h, k) in zip(some, sums):
            found[f].append(share(h, k))
        del asked
        free_shuffles(spark)
    return share(hits, known), found
