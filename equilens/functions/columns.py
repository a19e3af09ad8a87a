"""Small Column helpers shared by operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_div(num, den) -> Column:
    """num/den, 0.0 when the denominator is not positive (the method's rule)."""
    num = num if isinstance(num, Column) else F.col(num)
    den = den if isinstance(den, Column) else F.col(den)
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def rnd(c, scale: int = 6) -> Column:
    c = c if isinstance(c, Column) else F.col(c)
    return F.round(c.cast("double"), scale)


def all_of(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def mean_abs_pair_diff(df: DataFrame, part_cols, value_col: str, out_col: str = "mad") -> DataFrame:
    """Mean over unordered pairs of rows of |x_i - x_j|, per partition.

    Uses the sorted-rank identity  sum_{i<j} |x_i - x_j| = sum_k x_(k) (2k - G - 1),
    so no pair is ever materialised; partitions with fewer than 2 rows are
    dropped (the method omits a protected attribute with one group).
    """
    w = Window.partitionBy(*part_cols).orderBy(F.col(value_col))
    wc = Window.partitionBy(*part_cols)
    ranked = df.select(*part_cols, value_col,
                       F.row_number().over(w).alias("_k"),
                       F.count(F.lit(1)).over(wc).alias("_g"))
    return (ranked.groupBy(*part_cols)
            .agg(F.sum(F.col(value_col) * (2 * F.col("_k") - F.col("_g") - 1)).alias("_s"),
                 F.max("_g").alias("_g"))
            .where(F.col("_g") >= 2)
            .select(*part_cols, (F.col("_s") / (F.col("_g") * (F.col("_g") - 1) / 2)).alias(out_col)))
