"""Exact nearest neighbours against every pair of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import knn


def _brute(train, test, k):
    out = []
    train = [t for t in train if None not in t]
    for q in test:
        if None in q[1:] or not train:
            out.append((q[0], None))
            continue
        near = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(q[1:], t[2:])), t[0], t[1]) for t in train)[:k]
        out.append((q[0], sum(y for _, _, y in near) / len(near)))
    return sorted(out)


def _got(spark, train, test, d, k=5, **kw):
    feats = [f"x{i}" for i in range(d)]
    cols = ", ".join(f"{f} double" for f in feats)
    out = knn.knn_score(spark.createDataFrame(train, f"id long, y int, {cols}"), spark.createDataFrame(test, f"id long, {cols}"),
                        feats, "y", "id", k, keep=("id",), **kw).collect()
    assert all(r.pred_Y == (None if r.score_S is None else int(r.score_S > 0.5)) for r in out)
    return sorted((r.id, r.score_S) for r in out)


def _close(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == [None if s is None else pytest.approx(s) for _, s in want]


def test_clusters_ties_outliers_and_hot_points(spark):
    """A third of the train rows share one point; queries repeat, lie far outside, or on cell edges."""
    r = np.random.default_rng(0)
    pts = np.vstack([r.normal(c, 1.0, (150, 3)) for c in (0, 40, 400)]).round(1)
    pts = np.vstack([pts, np.tile([40.0, 40.0, 40.0], (220, 1))])
    train = [(int(i), int(r.integers(0, 2)), *map(float, p)) for i, p in zip(r.permutation(len(pts)), pts)]
    train += [(10_000, 1, None, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)]
    ask = np.vstack([pts[::25], r.normal(200, 300, (15, 3)), np.tile([40.0] * 3, (6, 1))]).round(1)
    test = [(i, *map(float, p)) for i, p in enumerate(ask)] + [(900, None, 1.0, 1.0)]
    _close(_got(spark, train, test, 3, rows_per_cell=12), _brute(train, test, 5))


def test_fewer_rows_than_neighbours_and_one_feature(spark):
    train, test = [(1, 1, 0.0), (2, 0, 5.0), (3, 1, 5.0)], [(1, 1.0), (2, -0.0), (3, None)]
    _close(_got(spark, train, test, 1), _brute(train, test, 5))
    _close(_got(spark, [], test, 1), _brute([], test, 5))
    line = [(i, i % 3 == 0, float(i * i)) for i in range(300)]
    line = [(i, int(y), x) for i, y, x in line]
    ask = [(i, float(i * 301)) for i in range(60)]
    _close(_got(spark, line, ask, 1, k=7, rows_per_cell=9), _brute(line, ask, 7))


def test_few_values_of_a_feature_leave_no_large_cells(spark):
    """One feature has two values: the other is cut so fine that cells stay small, and neighbours exact."""
    pts = spark.range(8000).select((F.col("id") * 7919 % 8009).cast("double").alias("f0"), (F.col("id") % 2).cast("double").alias("f1"))
    (ax, ex), (ay, ey) = knn._slices(pts, ["f0", "f1"], 5)
    cells = pts.groupBy(knn._slice_of(F.col(ax), ex), knn._slice_of(F.col(ay), ey)).count()
    assert ax == "f0" and len(ex) > knn.MAX_SLICES
    assert cells.agg(F.max("count")).first()[0] <= 40
    below = pts.select("f0", knn._slice_of(F.col("f0"), ex).alias("s")).limit(500).collect()
    assert all(r.s == sum(e < r.f0 for e in ex) for r in below)
    r = np.random.default_rng(1)
    train = [(i, int(r.integers(0, 2)), float(r.integers(0, 9000)), float(i % 2)) for i in range(600)]
    test = [(i, float(r.integers(-50, 9050)), float(i % 2)) for i in range(12)]
    _close(_got(spark, train, test, 2, rows_per_cell=0.5), _brute(train, test, 5))
