"""Model-level accuracy and the thirteen pairwise group-fairness metrics.

Each fairness metric is the mean over unordered group pairs of an absolute
difference of a per-group quantity.  The pairs are never built: the mean
absolute pairwise difference has a closed form over the sorted values, and
``max(|u|, |v|) = (|u + v| + |u - v|) / 2`` turns the two "max" metrics
(CUAE, EO) into the same form.  Work after the single confusion aggregate
is a window over (number of protected attributes x 15 x G) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.columns import mean_abs_pair_diff, safe_div
from equilens.operators.confusion import OVERALL, confusion_table
from equilens.spec import FAIRNESS_METRICS

# metric -> per-group quantity whose pairwise |difference| is averaged
_SINGLE = {
    "BNC": "mean_score_neg", "BPC": "mean_score_pos", "EOpp": "TPR", "FDRP": "FDR",
    "FORP": "FOR", "FNRB": "FNR", "FPRB": "FPR", "NPVP": "NPV", "OAE": "ACC",
    "PPVP": "PPV", "SP": "PPOS",
}
# metric -> (a, b): mean over pairs of max(|delta a|, |delta b|)
_MAXPAIR = {"CUAE": ("PPV", "NPV"), "EO": ("TPR", "FPR")}


def _quantities(groups: DataFrame, by=()) -> DataFrame:
    """Unpivot the per-group table into (by..., protected, quantity, x)."""
    cols = {q: F.col(q) for q in sorted(set(_SINGLE.values()))}
    for m, (a, b) in _MAXPAIR.items():
        cols[f"{m}+"] = F.col(a) + F.col(b)
        cols[f"{m}-"] = F.col(a) - F.col(b)
    wide = groups.select(*by, "protected", *[v.cast("double").alias(k) for k, v in cols.items()])
    return wide.unpivot([*by, "protected"], list(cols), "quantity", "x")


def fairness_from_confusion(conf: DataFrame, metrics=None, by=()) -> DataFrame:
    """``(by..., metric, protected, value)`` from a confusion table (overall row ignored).

    ``by`` adds grouping keys (e.g. a time window) to every partition."""
    metrics = list(metrics or FAIRNESS_METRICS)
    by = list(by)
    groups = conf.where(F.col("protected") != OVERALL)
    mad = mean_abs_pair_diff(_quantities(groups, by), [*by, "protected", "quantity"], "x", "mad")
    mapping = []
    for m in metrics:
        if m in _SINGLE:
            mapping.append((m, _SINGLE[m], 1.0))
        else:
            mapping += [(m, f"{m}+", 0.5), (m, f"{m}-", 0.5)]
    spark = conf.sparkSession
    mdf = F.broadcast(spark.createDataFrame(mapping, "metric string, quantity string, w double"))
    return (mad.join(mdf, "quantity")
               .groupBy(*by, "metric", "protected")
               .agg(F.sum(F.col("w") * F.col("mad")).alias("value")))


def accuracy_from_confusion(conf: DataFrame) -> DataFrame:
    """``(metric, value)`` rows for ACC, F1, Recall, Precision of the overall row."""
    o = conf.where(F.col("protected") == OVERALL)
    p, r = F.col("PPV"), F.col("TPR")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    wide = o.select(F.col("ACC").alias("ACC"), f1.alias("F1"), r.alias("Recall"), p.alias("Precision"))
    return wide.unpivot([], ["ACC", "F1", "Recall", "Precision"], "metric", "value")


def overall_fairness(fair: DataFrame) -> DataFrame:
    """max(0, 1 - mean of all fairness values); 1.0 when there is none (higher is fairer)."""
    return fair.agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(F.avg("value"), F.lit(0.0)))
                    .alias("overall_fairness"))


def performance_matrix(conf: DataFrame) -> DataFrame:
    """Group x (accuracy, precision, recall, f1, support)."""
    p, r = F.col("PPV"), F.col("TPR")
    return conf.where(F.col("protected") != OVERALL).select(
        "protected", "group_value", F.col("ACC").alias("accuracy"), p.alias("precision"),
        r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"),
        F.col("n").alias("support"))


def disparity(conf: DataFrame, rate: str, mode: str = "difference") -> DataFrame:
    """Disparity of any rate across groups: max-min (difference) or min/max (ratio)."""
    g = conf.where(F.col("protected") != OVERALL).groupBy("protected").agg(
        F.max(rate).alias("hi"), F.min(rate).alias("lo"))
    v = (F.col("hi") - F.col("lo")) if mode == "difference" else safe_div(F.col("lo"), F.col("hi"))
    return g.select("protected", F.lit(rate).alias("rate"), F.lit(mode).alias("mode"), v.alias("value"))
