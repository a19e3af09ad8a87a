"""Exact k-nearest-neighbour classification as joins over grid cells.

The train rows are cut by exact quantiles of two features into a grid of slices with known
edges.  A query first opens the cells around its own, in growing rings, until it has ``k``
neighbours; its ``k``-th distance then bounds the cells that may hold nearer ones, and only
those whose box is no farther are opened.  Every step is an equality join on the cell, so no
query meets all rows, and nothing is cut off: a query that needs all cells opens all.

Equal points are one place: at most ``k`` rows of it (the smallest keys) can ever be neighbours,
and equal queries are answered once, so a value that a third of the rows share costs one cell row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.operators.prefix import quantile_table
from equilens.operators.sizing import written

ROWS_PER_CELL, MAX_SLICES = 200, 256
MAX_LINE = 4096         # slices of one feature where the other has few values


def _slices(points: DataFrame, features: list, rows_per_cell: int) -> list[tuple[str, list[float]]]:
    """Up to two features with their slice edges: those that the data spreads over most slices."""
    n = points.count()
    per_axis = min(max(int((n / rows_per_cell) ** (0.5 if len(features) > 1 else 1.0)), 1), MAX_SLICES)
    table = quantile_table(points, features, [i / per_axis for i in range(1, per_axis)]) if per_axis > 1 else {}
    edges = {c: sorted({x for x in table.get(c, []) if x is not None}) for c in features}
    axes = sorted(edges.items(), key=lambda e: (-len(e[1]), e[0]))[:2]
    # few values on the second axis leave fewer cells than wanted: the first is cut finer, else cells grow with the rows.
    # Any edges give the same neighbours, so a sketch of the quantiles will do
    per_line = min(int(n / rows_per_cell / (len(axes[1][1]) + 1 if len(axes) > 1 else 1)), MAX_LINE)
    if per_line > per_axis:
        c = axes[0][0]
        found = points.agg(F.percentile_approx(c, [i / per_line for i in range(1, per_line)], 10 * per_line)).first()[0]
        axes[0] = (c, sorted({x for x in found or [] if math.isfinite(x)}))
    return axes


def _ends(edges: list[float]) -> Column:
    if all(map(math.isfinite, edges)):
        return F.expr(f"array({', '.join(f'{e!r}D' for e in edges)})")
    return F.array(*[F.lit(e) for e in edges])


def _slice_of(x: Column, edges: list[float]) -> Column:
    """Number of edges below ``x``: slice ``s`` holds the values in ``(edge[s-1], edge[s]]``."""
    if len(edges) <= MAX_SLICES:
        return reduce(lambda a, e: a + (x > F.lit(e)).cast("int"), edges, F.lit(0))
    # whole steps of edges below x first, then the edges of the next step
    step = math.isqrt(len(edges)) + 1
    whole = reduce(lambda a, e: a + (x > F.lit(e)).cast("int"), edges[step - 1::step], F.lit(0)) * step
    return whole + F.size(F.filter(F.slice(_ends(edges), whole + 1, F.lit(step)), lambda e: e < x))


def _box_distance(x: Column, s: Column, edges: list[float]) -> Column:
    """Distance from ``x`` to the nearest end of slice ``s``; 0 inside."""
    if not edges:
        return F.lit(0.0)
    ends = _ends(edges)
    zero = F.lit(0.0)
    below = F.when(s > 0, F.get(ends, s - 1) - x)             # the slice begins above x
    above = F.when(s < len(edges), x - F.get(ends, s))        # the slice ends below x
    return F.greatest(zero, F.coalesce(below, zero), F.coalesce(above, zero))


def _around(s: Column, r: Column, edges: list[float]) -> Column:
    return F.sequence(F.greatest(s - r, F.lit(0)), F.least(s + r, F.lit(len(edges))))


def knn_score(train: DataFrame, test: DataFrame, features, label: str, key: str, k: int = 5, keep=(),
              rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``keep`` of every test row, ``pred_Y`` and ``score_S``: the share of label 1 among the ``k`` nearest
    train rows (Euclidean, all if there are fewer; ties to smaller keys), and whether it is over a half.

    Rows of ``train`` with a null feature, label or key are left out.  A test row with a null
    feature, or an empty train table, gets null.
    """
    features, keep = list(features), list(keep)
    values = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    names = [f"f{i}" for i in range(len(features))]
    rows = train.select(*[v + 0.0 for v in values], F.col(label).cast("int").alias("y"), F.col(key).alias("key")).toDF(*names, "y", "key").dropna()
    first = F.row_number().over(Window.partitionBy(*names).orderBy("key"))
    points = written(rows.withColumn("place", first).where(F.col("place") <= k).drop("place"), "points")
    axes = _slices(points, names, rows_per_cell)
    axes += [(names[0], [])] * (2 - len(axes))
    (ax, ex), (ay, ey) = axes
    points = points.withColumn("cx", _slice_of(F.col(ax), ex)).withColumn("cy", _slice_of(F.col(ay), ey))
    asked = test.select(*[v + 0.0 for v in values]).toDF(*names).dropna().distinct()
    asked = asked.withColumn("q", F.monotonically_increasing_id()) \
        .withColumn("sx", _slice_of(F.col(ax), ex)).withColumn("sy", _slice_of(F.col(ay), ey))
    asked = written(asked, "queries")
    target = points.select("cx", "cy", "y", "key", *[F.col(c).alias(f"p_{c}") for c in names])
    square = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in names])
    nearest = Window.partitionBy("q").orderBy("d2", "key")
    # by number: the cells are few bytes, so AQE would join them all, with all their pairs, in one task
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def neighbours(cells: DataFrame, so_far: DataFrame | None) -> DataFrame:
        """The ``k`` nearest of each query among the rows of its opened cells and those it has."""
        found = cells.repartition(tasks, "cx", "cy").join(target.repartition(tasks, "cx", "cy"), ["cx", "cy"]).select("q", square.alias("d2"), "key", "y")
        if so_far is not None:
            found = found.unionByName(so_far)
        return written(found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place"), "neighbours")

    def reach(best: DataFrame) -> DataFrame:
        return best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("most"))

    # rings until every query has k neighbours or has opened all cells
    r, widest, parts, open_ = 0, max(len(ex), len(ey)), [], asked
    while True:
        cells = open_.select("*", F.explode(_around(F.col("sx"), F.lit(r), ex)).alias("cx")) \
            .select("*", F.explode(_around(F.col("sy"), F.lit(r), ey)).alias("cy"))
        best = neighbours(cells, None)
        state = open_.join(reach(best), "q", "left").withColumn("ring", F.lit(r))
        full = (F.coalesce("n", F.lit(0)) >= k) | F.lit(r >= widest)
        parts.append((written(state.where(full), "closed"), best))
        if r >= widest:
            break
        open_ = written(state.where(~full).select(*asked.columns), "open")
        if open_.isEmpty():
            break
        r = 2 * r + 1
    done = reduce(DataFrame.unionByName, [s for s, _ in parts])
    best = reduce(DataFrame.unionByName, [b.join(s.select("q"), "q", "left_semi") for s, b in parts])
    # then the cells that may hold something nearer: within the k-th distance, outside the ring
    far = F.sqrt("most") * (1 + 1e-9)
    span = lambda x, e: F.sequence(_slice_of(x - far, e), _slice_of(x + far, e))
    more = done.where(F.col("n") >= k)
    more = more.select("*", F.explode(span(F.col(ax), ex)).alias("cx")).select("*", F.explode(span(F.col(ay), ey)).alias("cy"))
    dx, dy = _box_distance(F.col(ax), F.col("cx"), ex), _box_distance(F.col(ay), F.col("cy"), ey)
    outside = (F.abs(F.col("cx") - F.col("sx")) > F.col("ring")) | (F.abs(F.col("cy") - F.col("sy")) > F.col("ring"))
    near = dx * dx + dy * dy if ax != ay else dx * dx
    more = more.where(outside & (near <= F.col("most") * (1 + 1e-9)))
    final = neighbours(more.select("q", *names, "cx", "cy"), best)
    votes = final.groupBy("q").agg(F.avg("y").alias("score_S"))
    answers = asked.join(votes, "q").select(*[F.col(c).alias(f"a_{c}") for c in names], "score_S")
    out = test.select(*keep, *[(v + 0.0).alias(c) for v, c in zip([F.col(c).cast("double") for c in features], names)])
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"a_{c}") for c in names])
    return out.join(answers, same, "left").select(*keep, (F.col("score_S") > 0.5).cast("int").alias("pred_Y"), "score_S")
