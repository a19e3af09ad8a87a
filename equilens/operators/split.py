"""Deterministic splits, samples and the subgroup filter.

``randomSplit`` depends on partitioning and is not reproducible across
cluster layouts or after a lost executor; every split here is a pure
function of the row content: ``md5(key || ':' || seed)`` mapped to 0..999.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.operators.sizing import broadcast_if_small, written

CLASS_BROADCAST_ROWS = 100_000
RANGE_BITS = 14               # of the hash: ranges in which the rows of a class are counted


def hash_bucket(key_cols, seed, salt: str = "") -> Column:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    h = F.md5(F.concat(key, F.lit(f"{salt}:{seed}")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(1000))


def hash_split(df: DataFrame, key_cols, test_fraction: float = 0.3, seed: int = 1,
               out: str = "is_train") -> DataFrame:
    """70/30 (by default) split column; no shuffle, no driver work."""
    return df.withColumn(out, hash_bucket(key_cols, seed) < int(round((1 - test_fraction) * 1000)))


def hash_sample(df: DataFrame, key_cols, fraction: float, seed: int = 0) -> DataFrame:
    """Deterministic row sample; only applied when 0 < fraction < 1."""
    if not 0 < fraction < 1:
        return df
    return df.where(hash_bucket(key_cols, seed, salt="sample") < int(round(fraction * 1000)))


def stratified_split(df: DataFrame, key_cols, label: str, test_fraction: float = 0.3, seed: int = 42,
                     out: str = "is_train") -> DataFrame:
    """Per-class split with exact class proportions.

    Rows are ranked inside their class by the content hash; the first
    round(test_fraction * n_class) go to test.  No row is shuffled or ordered for that: one
    pass counts classes by ranges of the hash, a second counts the hashes of the one range of
    each class where its quota ends.  With a single class the split falls back to ``hash_split``.
    """
    key = F.md5(F.concat(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]), F.lit(f"strat:{seed}")))
    # read three times; of the hash only the leading 60 bits are written, which tell nearly all rows apart
    lead = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    h = written(df.withColumn("_p", lead), "hashed")
    ranges = written(h.groupBy(F.col(label).alias("_y"), F.shiftright("_p", 60 - RANGE_BITS).alias("_r")).agg(F.count(F.lit(1)).alias("_c")), "ranges")
    sizes = ranges.groupBy("_y").agg(F.sum("_c").alias("_n"))
    if sizes.limit(2).count() < 2:
        return hash_split(h.select(*df.columns), key_cols, test_fraction, seed, out)
    upto = Window.partitionBy("_y").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_y")
    # per class: the range where the quota ends, and the rows of the class before it
    ends = ranges.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_q", F.round(F.sum("_c").over(whole) * test_fraction)) \
        .where(F.col("_upto") > F.col("_q")).groupBy("_y").agg(F.min(F.struct("_r", (F.col("_upto") - F.col("_c")).alias("_before"), "_q")).alias("_e")) \
        .select("_y", "_e.*")
    # classes are few: joins by the class would bring all rows of a class to one task
    ends = broadcast_if_small(written(ends, "ends"), CLASS_BROADCAST_ROWS)
    inside = h.join(ends, F.col(label).eqNullSafe(F.col("_y")) & (F.shiftright("_p", 60 - RANGE_BITS) == F.col("_r"))) \
        .groupBy("_y", key.alias("_h")).agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_q").alias("_q"))
    # per class: the largest hash of the range still inside the test quota (one row per class)
    cuts = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_y").orderBy("_h")) + F.col("_before")) \
        .where(F.col("_upto") <= F.col("_q")).groupBy("_y").agg(F.max("_h").alias("_cut"))
    lead_cut = F.conv(F.substring("_cut", 1, 15), 16, 10).cast("long")
    cuts = ends.join(cuts.withColumnRenamed("_y", "_z"), F.col("_y").eqNullSafe(F.col("_z")), "left") \
        .select("_y", "_cut", F.coalesce(lead_cut, F.shiftleft("_r", 60 - RANGE_BITS) - 1).alias("_to"))
    cuts = broadcast_if_small(written(cuts, "cuts"), CLASS_BROADCAST_ROWS)
    # a class whose quota takes all its rows has no end
    train = F.when(F.col("_to").isNull(), F.lit(False)).when(F.col("_p") != F.col("_to"), F.col("_p") > F.col("_to")) \
        .otherwise(F.coalesce(key > F.col("_cut"), F.lit(False)))
    return h.join(cuts, F.col(label).eqNullSafe(F.col("_y")), "left").select(*df.columns, train.alias(out))


def subgroup_filter(df: DataFrame, conditions: dict, check_nonempty: bool = True) -> DataFrame:
    """Conjunctive equality filter; unknown feature or empty result raises."""
    if not conditions:
        raise ValueError("no conditions given")
    for f in conditions:
        if f not in df.columns:
            raise ValueError(f"feature {f!r} not found")
    cond = reduce(lambda a, b: a & b, [F.col(f) == F.lit(v) for f, v in conditions.items()])
    out = df.where(cond)
    if check_nonempty and out.limit(1).count() == 0:
        raise ValueError("no rows match the conditions")
    return out
