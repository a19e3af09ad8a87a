"""Confusion counts and rates per protected group (one pass over the data).

All protected attributes and the overall row are computed by a single
GROUPING SETS aggregate, so the scored table is scanned once and only
(sum over protected of G) + 1 rows are shuffled after map-side combine.
A hot group (one value holding a third of the rows) is harmless: partial
aggregation reduces it to one row per map task before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.columns import safe_div

OVERALL = "__overall__"


def _counters(label: str, pred: str, score: str):
    y = F.coalesce(F.col(label) != 0, F.lit(False))       # astype(bool): non-zero is true
    p = F.coalesce(F.col(pred) != 0, F.lit(False))
    as_long = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return [
        F.count(F.lit(1)).cast("long").alias("n"),
        as_long(p & y).alias("tp"),
        as_long(p & ~y).alias("fp"),
        as_long(~p & y).alias("fn"),
        as_long(~p & ~y).alias("tn"),
        # class means of the score use the literal comparisons label == 1 / label == 0
        as_long(F.col(label) == 1).alias("n_pos"),
        as_long(F.col(label) == 0).alias("n_neg"),
        F.sum(F.when(F.col(label) == 1, F.col(score))).alias("sum_score_pos"),
        F.sum(F.when(F.col(label) == 0, F.col(score))).alias("sum_score_neg"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    """Add the ten rates and the class score means; empty denominators give 0.0."""
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    return df.select(
        "*",
        safe_div(tp, tp + fn).alias("TPR"),
        safe_div(fp, fp + tn).alias("FPR"),
        safe_div(fn, tp + fn).alias("FNR"),
        safe_div(tn, tn + fp).alias("TNR"),
        safe_div(tp, tp + fp).alias("PPV"),
        safe_div(tn, tn + fn).alias("NPV"),
        safe_div(fp, tp + fp).alias("FDR"),
        safe_div(fn, fn + tn).alias("FOR"),
        safe_div(tp + tn, n).alias("ACC"),
        safe_div(tp + fp, n).alias("PPOS"),
        safe_div(F.coalesce(F.col("sum_score_pos"), F.lit(0.0)), F.col("n_pos")).alias("mean_score_pos"),
        safe_div(F.coalesce(F.col("sum_score_neg"), F.lit(0.0)), F.col("n_neg")).alias("mean_score_neg"),
    )


def confusion_table(df: DataFrame, protected, label: str = "label_Y", pred: str = "pred_Y",
                    score: str = "score_S", include_overall: bool = True) -> DataFrame:
    """Long table ``(protected, group, n, tp, fp, fn, tn, ..., rates)``.

    ``protected`` is ``'__overall__'`` (group null) for the whole-table row.
    Group values are rendered as strings; a null group value becomes ``'NaN'``.
    """
    protected = list(protected)
    sets = [[c] for c in protected] + ([[]] if include_overall else [])
    agg = (df.groupingSets(sets, *protected)
             .agg(*_counters(label, pred, score),
                  *[F.grouping(c).alias(f"_g_{i}") for i, c in enumerate(protected)]))
    which = F.lit(OVERALL)
    group = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(protected))):
        which = F.when(F.col(f"_g_{i}") == 0, F.lit(c)).otherwise(which)
        group = F.when(F.col(f"_g_{i}") == 0,
                       F.coalesce(F.col(c).cast("string"), F.lit("NaN"))).otherwise(group)
    counts = agg.select(which.alias("protected"), group.alias("group_value"),
                        "n", "tp", "fp", "fn", "tn", "n_pos", "n_neg", "sum_score_pos", "sum_score_neg")
    return with_rates(counts)
