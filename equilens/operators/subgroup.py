"""Intersectional groups, subgroup discovery, calibration by group, subgroup report."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.operators.confusion import _counters, with_rates
from equilens.functions.columns import safe_div


def intersection_sets(protected, min_size: int = 2):
    protected = list(protected)
    return [list(s) for k in range(min_size, len(protected) + 1) for s in combinations(protected, k)]


def intersectional_confusion(df: DataFrame, protected, min_size: int = 2, label="label_Y", pred="pred_Y",
                             score="score_S") -> DataFrame:
    """Confusion rows for every intersection of >= ``min_size`` protected attributes, in one
    GROUPING SETS pass.  ``protected`` is the joined attribute names ('a&b'), the group the
    joined values ('x|y'); nulls render as 'NaN'."""
    protected = list(protected)
    sets = intersection_sets(protected, min_size)
    agg = df.groupingSets(sets, *protected).agg(*_counters(label, pred, score),
                                                *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(protected)])
    name, grp = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in sets:
        cond = None
        for i, c in enumerate(protected):
            bit = (F.col(f"_g{i}") == (0 if c in s else 1))
            cond = bit if cond is None else cond & bit
        name = F.when(cond, F.lit("&".join(s))).otherwise(name)
        grp = F.when(cond, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in s])) \
            .otherwise(grp)
    out = agg.select(name.alias("protected"), grp.alias("group_value"), "n", "tp", "fp", "fn", "tn", "n_pos",
                     "n_neg", "sum_score_pos", "sum_score_neg")
    return with_rates(out)


def subgroups_top(df: DataFrame, features, min_support: int = 100, k: int = 10, label="label_Y",
                  pred="pred_Y") -> DataFrame:
    """Subgroups = every combination of feature values (cube, null = 'any'), support >= min_support,
    ranked by |accuracy(subgroup) - accuracy(all)|; top ``k`` (ties by description)."""
    features = list(features)
    correct = (F.col(label) == F.col(pred)).cast("int")
    c = (df.cube(*features).agg(F.count(F.lit(1)).cast("long").alias("support"),
                                F.sum(correct).cast("long").alias("correct"),
                                *[F.grouping(f).alias(f"_g{i}") for i, f in enumerate(features)]))
    desc = F.concat_ws(" & ", *[F.when(F.col(f"_g{i}") == 0, F.concat(F.lit(f"{f}="), F.col(f).cast("string")))
                                for i, f in enumerate(features)])
    c = c.withColumn("subgroup", desc)
    # the grand-total row of the cube (exactly one row) joined on a constant key
    overall = c.where(F.col("subgroup") == "").select(F.lit(0).alias("_k"), F.col("support").alias("n_all"),
                                                     F.col("correct").alias("c_all"))
    s = (c.where((F.col("subgroup") != "") & (F.col("support") >= min_support)).withColumn("_k", F.lit(0))
          .join(F.broadcast(overall), "_k")
          .select("subgroup", "support", (F.col("correct") / F.col("support")).alias("accuracy"),
                  (F.col("c_all") / F.col("n_all")).alias("overall_accuracy")))
    s = s.withColumn("gap", F.abs(F.col("accuracy") - F.col("overall_accuracy")))
    # distributed top-k (TakeOrderedAndProject keeps k rows per task); the rank window sees k rows
    top = s.orderBy(F.desc("gap"), "subgroup").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gap"), "subgroup")))


def calibration_by_group(df: DataFrame, protected, bins: int = 10, label="label_Y", score="score_S") -> DataFrame:
    """Per group: RMSE between mean score and observed rate over ``bins`` equal score bins,
    weighted by bin size: sqrt(sum n_b (avg score - avg y)^2 / sum n_b)."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    items = F.explode(F.array(*[F.struct(F.lit(p).alias("protected"),
                                         F.coalesce(F.col(p).cast("string"), F.lit("NaN")).alias("group_value"))
                                for p in protected]))
    per_bin = (df.select(items.alias("i"), b.alias("bin"), F.col(score).alias("s"), F.col(label).alias("y"))
                 .select("i.*", "bin", "s", "y")
                 .groupBy("protected", "group_value", "bin")
                 .agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("ms"), F.avg("y").alias("my")))
    return per_bin.groupBy("protected", "group_value").agg(
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("ms") - F.col("my"), 2)) / F.sum("n")).alias("calibration_rmse"),
        F.sum("n").cast("long").alias("n"))


def subgroup_report(scored: DataFrame, conditions: dict, test_flag: str = "is_train") -> DataFrame:
    """Subgroup vs overall: size, share, accuracy/precision/recall/f1/fpr.

    ``scope='all'`` scores every row of the subgroup (training rows included, as the
    original endpoint does); ``scope='test'`` only held-out rows.  Overall is the test set."""
    cond = None
    for f, v in conditions.items():
        c = F.col(f) == F.lit(v)
        cond = c if cond is None else cond & c
    y, p = F.col("label_Y") == 1, F.col("pred_Y") == 1
    test = ~F.col(test_flag)

    def stats(mask, scope):
        cnt = lambda c: F.sum(F.when(mask & c, 1).otherwise(0))
        tp, fp, fn, tn = cnt(p & y), cnt(p & ~y), cnt(~p & y), cnt(~p & ~y)
        prec, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
        return [F.lit(scope).alias("scope"), F.sum(F.when(mask, 1).otherwise(0)).cast("long").alias("size"),
                safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"),
                rec.alias("recall"), F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"),
                safe_div(fp, fp + tn).alias("fpr")]

    row = scored.agg(F.struct(*stats(cond, "subgroup_all")).alias("a"),
                     F.struct(*stats(cond & test, "subgroup_test")).alias("b"),
                     F.struct(*stats(test, "overall_test")).alias("c"),
                     F.count(F.lit(1)).alias("overall_size"))
    out = row.select(F.explode(F.array("a", "b", "c")).alias("r"), "overall_size").select("r.*", "overall_size")
    return out.withColumn("percentage", F.col("size") * 100.0 / F.col("overall_size"))
