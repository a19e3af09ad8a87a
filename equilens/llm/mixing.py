"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1 over all taken words.  A source with target ``T`` has the
weight schedule ``w(t) = T (1 + b (2t - 1))``; the slopes ``b`` cancel out over the sources,
so the total rate is constant.  Integrated, the schedule is the cumulative demand
``D(t) = T (t + b (t^2 - t))``; a copy whose middle word stands at ``y T`` in its source's
stream gets the training position ``t = D^-1(y T)``, and documents are range-sorted by it.

Cumulative word counts within a source use slices of a text hash whose number follows the
source's row count: a source with a third of all rows is spread over that many more slices,
and only slice totals meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import fresh, materialize, n_words

MAX_PASSES = 3           # no source is repeated more often
SLICE_ROWS = 8192        # rows that one window task of a source holds, about


def targets(docs: DataFrame, source: str = "source", size: str = "size", max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: ``source, source_size, n_rows, target, slope``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating; they share all words,
    and what exceeds ``max_passes`` times a source's size is shared anew by weight.  The
    windows below run over one row per source.
    """
    per = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    # sources fill up in the order of cap / weight; the first k are capped where the share left
    # for the others, by weight, stays below the next one's cap
    cap = F.col("source_size") * max_passes
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("share", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
                         / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("open", F.col("share") * F.col("weight") < cap)
    rate = F.min(F.when(F.col("open"), F.struct((cap / F.col("weight")).alias("r"), F.col("share").alias("s")))).over(every)["s"]
    per = per.withColumn("rate", rate)
    per = per.withColumn("target", F.when(F.col("rate").isNull(), cap.cast("double"))
                         .otherwise(F.least(cap.cast("double"), F.col("rate") * F.col("weight"))))
    lean = (F.col("weight") - 2) / 2
    mean = F.sum(F.col("target") * lean).over(every) / F.sum("target").over(every)
    return per.withColumn("slope", F.coalesce(lean - mean, F.lit(0.0))) \
        .select("source", "source_size", "n_rows", "target", "slope")


def position_at(y: Column, slope: Column) -> Column:
    """Time at which the integrated schedule reaches the share ``y`` of its target."""
    c = 1 - slope
    root = c + F.sqrt(F.greatest(c * c + 4 * slope * y, F.lit(0.0)))
    return F.when(root > 0, F.least(2 * y / root, F.lit(1.0))).otherwise(F.lit(0.0))


def assign(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
           keep: tuple[str, ...] = ("doc_id",), max_passes: int = MAX_PASSES) -> DataFrame:
    """``keep`` columns of every row with ``size, source_size, target, taken, positions``.

    ``positions`` holds the training position of each copy that the mix takes: every document
    of a source goes in as many whole passes as its target holds, and a last partial pass
    takes documents in the order of a text hash until the rest of the target is met (to half
    a document).  Null and empty texts have size 0 and are not taken; a null source is a
    source of its own; of repeated rows each stands for itself, in any order.
    """
    # equal ids and texts are interchangeable; the digest of the text spreads null ids
    key = F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    u = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    cols = list(keep)
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)], F.col(source).alias("mix_source"),
                       n_words(F.col(text)).alias("size"), key.alias("mix_key"))
    stats = materialize(targets(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size")),
                                max_passes=max_passes), "targets")
    placed = slim.join(stats, F.col("mix_source").eqNullSafe(F.col("source")))
    slices = F.ceil(F.col("n_rows") / SLICE_ROWS)
    placed = placed.withColumn("slice", F.floor(u * slices).cast("int"))
    narrow = docs.select(F.col(source).alias("mix_source"), n_words(F.col(text)).alias("size"), key.alias("mix_key")) \
        .join(stats.select("source", "n_rows"), F.col("mix_source").eqNullSafe(F.col("source"))) \
        .withColumn("slice", F.floor(u * slices).cast("int"))
    totals = narrow.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("t_source"), F.col("slice").alias("t_slice"),
                           F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("source", "slice").orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    placed = placed.join(materialize(totals, "slices"), F.col("source").eqNullSafe(F.col("t_source"))
                         & (F.col("slice") == F.col("t_slice")))
    begin = F.col("offset") + F.col("inner")
    middle = begin + F.col("size") / 2
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    copies = F.when(F.col("size") > 0, passes + (middle <= rest).cast("int")).otherwise(0).cast("int")
    y = lambda i: (i * F.col("source_size") + middle) / F.col("target")
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1),
                                                        lambda i: position_at(y(i), F.col("slope")))) \
        .otherwise(F.array().cast("array<double>"))
    out = placed.withColumn("copies", copies).withColumn("positions", positions)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(cols)], "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), "positions")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        max_passes: int = MAX_PASSES) -> DataFrame:
    """The training stream: ``docs``' columns, one row for each copy taken, in training order."""
    names = docs.columns
    position, row = fresh(docs, "position", "row")
    packed = docs.withColumn(row, F.struct(*names))
    plan = assign(packed, text, source, doc_id, (row,), max_passes)
    stream = plan.select(F.col(row), F.explode("positions").alias(position))
    return stream.orderBy(position, F.col(f"{row}.{doc_id}")).select(*[F.col(f"{row}.`{c}`").alias(c) for c in names])
