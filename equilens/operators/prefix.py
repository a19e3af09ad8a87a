"""Running totals without a single-task window, and exact quantiles without ordering.

``running_sums`` computes inclusive cumulative sums ordered by ``order`` within ``keys``.  A
plain ``Window.partitionBy(keys).orderBy(order)`` would put all rows of a key into one task.
Here the ordering column is cut into slices by bounds that are computed once and then stand
in the plan as literals, so the slice number is a pure function of the row: the totals of the
slices and the running sums inside them agree whatever Spark recomputes or reuses.  Inputs
should be pre-aggregated (unique per keys + order), which bounds a hot value to one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.operators.sizing import broadcast_if_small, written

MIN_SLICES, MAX_SLICES = 8, 200     # bounds in the plan; rows of a slice: about rows / slices
SKETCHES = 32                       # tasks that merge the sketches of the scan's tasks
OFFSET_BROADCAST_ROWS = 50_000


def slice_count(df: DataFrame) -> int:
    return min(max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MIN_SLICES), MAX_SLICES)


def slice_of(df: DataFrame, by: Column, n: int) -> Column:
    """Slice number of a row: how many of the (approximate) ``n``-quantiles of ``by`` lie below it.

    The quantiles are taken over all rows, so a key's share of the slices follows its share of
    the distinct values.  Null goes to slice 0.
    """
    # two rounds: some tasks merge the sketches of the scan, one the quantiles of these, weighted by their rows
    at, part = [i / n for i in range(1, n)], F.pmod(F.spark_partition_id(), F.lit(SKETCHES))
    first = df.select(by.alias("v"), part.alias("s")).groupBy("s").agg(F.percentile_approx("v", at, 50 * n).alias("q"), F.count("v").alias("c"))
    points = first.where("c > 0").select("c", F.explode("q").alias("v"))
    cuts = points.agg(F.percentile("v", at, F.col("c"))).first()[0] or []
    return F.coalesce(reduce(lambda a, c: a + (by > F.lit(c)).cast("int"), sorted(set(cuts)), F.lit(0)), F.lit(0))


def text_slice_of(df: DataFrame, by: Column, n: int) -> Column:
    """``slice_of`` for strings: the bounds are quantiles of the 20 ``n`` distinct strings of least hash.

    They only share the rows out, so a sample will do; bounds are cut to 1,000 characters.
    """
    seen = df.select(F.substring(by, 1, 1000).alias("t")).where("t IS NOT NULL").distinct().orderBy(F.xxhash64("t"), "t").limit(20 * n)
    t = sorted(r["t"] for r in seen.collect())
    cuts = sorted({t[len(t) * i // n] for i in range(1, n)}) if t else []
    return F.coalesce(reduce(lambda a, c: a + (by > F.lit(c)).cast("int"), cuts, F.lit(0)), F.lit(0))


def _slice_starts(sliced: DataFrame, keys, sum_cols) -> DataFrame:
    """``(keys..., _slice, _o_<col>)``: sums over the slices before; one row for each key and slice."""
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_slice", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                            for c in sum_cols])


def running_sums(df: DataFrame, keys, order, sum_cols, slice_by: Column | None = None, n_slices: int | None = None,
                 prefix: str = "cum_", slicer: Callable[[DataFrame, int], Column] | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` ordered by ``order`` within ``keys`` (null-safe in the keys).

    ``slice_by``: a number that never falls along ``order`` (by default the first ordering
    column itself).  ``slicer``: gives the slice number itself, from the rows and the number
    of slices.  The offsets have one row for each key and slice; few of them
    are broadcast, so the ordered rows are not exchanged again.
    """
    keys, order, sum_cols = list(keys), list(order), list(sum_cols)
    df = written(df, "ordered")                # read three times: bounds, totals, sums
    by = F.col(order[0]).cast("double") if slice_by is None else slice_by
    n = n_slices or slice_count(df)
    sliced = df.withColumn("_slice", slicer(df, n) if slicer else slice_of(df, by, n))
    starts = _slice_starts(sliced, keys, sum_cols)
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"),
                           *[f"_o_{c}" for c in sum_cols])
    starts = broadcast_if_small(written(starts, "offsets"), OFFSET_BROADCAST_ROWS)
    upto = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(c).over(upto).alias(f"_l_{c}") for c in sum_cols])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col("_slice") == F.col("_s"))
    return local.join(starts, same).select(*[F.col(c) for c in df.columns],
                                           *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in sum_cols])


def hash_fraction(hex_digest: Column) -> Column:
    """The leading 32 bits of a hex digest as a number: grows with the digest."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double")


# ---- exact quantiles by counting refinement ------------------------------------------------
FIRST_BINS, NEXT_BINS = 4096, 1024


def _refine(df: DataFrame, cols, ranges: dict, bins: int) -> dict:
    """One pass over the rows: counters, least and greatest value of every bin of the open ranges.

    ``ranges`` maps a number to ``(column number, lo, hi)``; the ranges of a column are disjoint.
    A value's bin never falls as the value grows, and ``lo`` and ``hi`` lie in different bins, so
    every pass narrows.  Returns, per range, its filled bins in order as ``(count, least, greatest)``.
    """
    by_col = {}
    for r, (i, lo, hi) in ranges.items():
        by_col.setdefault(i, []).append((lo, hi, r))
    items = []
    for i, some in by_col.items():
        some.sort()
        v = F.col(cols[i]).cast("double")
        # the first range that doesn't end below the value, and its bounds as literal arrays
        k = reduce(lambda a, x: a + (v > F.lit(x[1])).cast("int"), some, F.lit(0))
        pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), k)
        lo, half, width = (pick(x) for x in ([x[0] for x in some], [x[0] * 0.5 for x in some], [x[1] * 0.5 - x[0] * 0.5 for x in some]))
        # neighbours among the least numbers have no width left
        b = F.when(width == 0, (v > lo).cast("int")).otherwise(F.floor((v * 0.5 - half) / width * F.lit(float(bins - 1))).cast("int"))
        items.append(F.when(v >= lo, F.struct(pick([x[2] for x in some]).alias("r"), b.alias("b"), v.alias("v"))))
    rows = (df.select(F.explode(F.array(*items)).alias("i")).where(F.col("i").isNotNull()).select("i.*").groupBy("r", "b")
              .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect())
    out = {r: [] for r in ranges}
    for row in sorted(rows, key=lambda x: (x["r"], x["b"])):
        out[row["r"]].append((row["n"], row["least"], row["most"]))
    return out


def _select_ranks(df: DataFrame, cols, wanted: dict) -> dict:
    """``{(column number, rank): value}`` of the finite values; ``wanted`` maps a column number to
    ``(lo, hi, ranks)``.  Each pass keeps, of every column, only the bins that hold a wanted rank."""
    found, open_ = {}, []                  # open ranges: column number, lo, hi, ranks with their place in the range
    for i, (lo, hi, ranks) in wanted.items():
        open_.append((i, lo, hi, [(r, r) for r in ranks]))
    bins = FIRST_BINS
    while True:
        left = []
        for i, lo, hi, ranks in open_:
            if lo == hi:
                found.update({(i, r): lo for r, _ in ranks})
            elif ranks:
                left.append((i, lo, hi, ranks))
        if not left:
            return found
        counted = _refine(df, cols, {k: (i, lo, hi) for k, (i, lo, hi, _) in enumerate(left)}, bins)
        open_, bins = [], NEXT_BINS
        for k, (i, _, _, ranks) in enumerate(left):
            before = 0
            for n, least, most in counted[k]:
                here = [(r, at - before) for r, at in ranks if before <= at < before + n]
                if here:
                    open_.append((i, least, most, here))
                before += n


def quantile_table(df: DataFrame, cols, qs) -> dict:
    """Driver dict {col: [quantiles in the order of qs]}: exact, linearly interpolated (the pandas
    and numpy default), nulls left out, None for a column without values.  Infinities and, above
    them, NaN count as the values that Spark's order makes of them.

    Counting refinement: one aggregate gives extremes and counts, then each pass counts all open
    ranges of all columns in bins and keeps the bins that hold a wanted rank.  No value is shuffled
    or ordered: a pass exchanges one row for each task and filled bin.  A pass narrows a range a
    thousandfold, so two or three passes serve any common column; equal values never need more.
    """
    cols, qs = list(cols), [float(q) for q in qs]
    if not cols:
        return {}
    base = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).persist()
    names, inf = base.columns, float("inf")
    parts = []
    for i, c in enumerate(names):
        finite = F.when(~F.isnan(c) & (F.abs(c) != inf), F.col(c) + 0.0)
        parts += [F.count(finite).alias(f"n{i}"), F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}"),
                  F.count_if(F.col(c) == -inf).alias(f"low{i}"), F.count_if(F.col(c) == inf).alias(f"high{i}"),
                  F.count_if(F.isnan(c)).alias(f"nan{i}")]
    st = base.agg(*parts).first()
    wanted, places = {}, {}
    for i in range(len(names)):
        n = st[f"low{i}"] + st[f"n{i}"] + st[f"high{i}"] + st[f"nan{i}"]
        places[i] = [(q, (n - 1) * q) for q in qs] if n else []
        ranks = {int(math.floor(h)) for _, h in places[i]} | {int(math.ceil(h)) for _, h in places[i]}
        inside = sorted(r - st[f"low{i}"] for r in ranks if 0 <= r - st[f"low{i}"] < st[f"n{i}"])
        if inside:
            wanted[i] = (st[f"lo{i}"], st[f"hi{i}"], inside)
    got = _select_ranks(base, names, wanted)
    base.unpersist()

    def value(i: int, rank: int) -> float:
        if rank < st[f"low{i}"]:
            return -inf
        if rank < st[f"low{i}"] + st[f"n{i}"]:
            return got[(i, rank - st[f"low{i}"])] + 0.0
        return inf if rank < st[f"low{i}"] + st[f"n{i}"] + st[f"high{i}"] else float("nan")

    def at(i: int, h: float) -> float:
        lo, hi = value(i, int(math.floor(h))), value(i, int(math.ceil(h)))
        return lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)

    return {c: [at(i, h) for _, h in places[i]] or [None] * len(qs) for i, c in enumerate(cols)}


def quantile_values(df: DataFrame, col: str, qs) -> list:
    """Exact quantiles of one column in the order of ``qs``."""
    return quantile_table(df, [col], qs)[col]
