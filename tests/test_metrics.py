import itertools
import random

import pytest
from pyspark.sql import functions as F

from equilens.operators.confusion import confusion_table
from equilens.operators.fairness import (accuracy_from_confusion, fairness_from_confusion, overall_fairness)
from equilens.functions.columns import mean_abs_pair_diff


def _scored(spark, rows):
    return spark.createDataFrame(rows, "label_Y int, pred_Y int, score_S double, o string")


def test_identical_groups_are_perfectly_fair(spark):
    base = [(1, 1, .9), (0, 1, .6), (1, 0, .3), (0, 0, .1)]
    rows = [(y, p, s, g) for g in "ABC" for (y, p, s) in base]
    fair = fairness_from_confusion(confusion_table(_scored(spark, rows), ["o"]))
    vals = [r["value"] for r in fair.collect()]
    assert len(vals) == 13 and all(abs(v) < 1e-12 for v in vals)
    assert overall_fairness(fair).first()["overall_fairness"] == pytest.approx(1.0)


def test_single_group_attribute_is_omitted(spark):
    fair = fairness_from_confusion(confusion_table(_scored(spark, [(1, 1, .5, "A"), (0, 0, .2, "A")]), ["o"]))
    assert fair.count() == 0
    assert overall_fairness(fair).first()["overall_fairness"] == 1.0


def test_empty_denominators_give_zero(spark):
    # group B has no positives and no predicted positives
    rows = [(1, 1, .9, "A"), (0, 0, .1, "A"), (0, 0, .2, "B"), (0, 0, .3, "B")]
    conf = {r["group_value"]: r for r in confusion_table(_scored(spark, rows), ["o"]).collect()}
    b = conf["B"]
    assert b["TPR"] == 0.0 and b["PPV"] == 0.0 and b["FNR"] == 0.0 and b["mean_score_pos"] == 0.0
    assert b["TNR"] == 1.0 and b["NPV"] == 1.0


def test_metrics_match_brute_force_pairs(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 1), rnd.random(), rnd.choice("ABCDE")) for _ in range(400)]
    conf = confusion_table(_scored(spark, rows), ["o"])
    g = {r["group_value"]: r for r in conf.where("protected = 'o'").collect()}
    fair = {r["metric"]: r["value"] for r in fairness_from_confusion(conf).collect()}
    pairs = list(itertools.combinations(sorted(g), 2))
    mean = lambda f: sum(f(g[a], g[b]) for a, b in pairs) / len(pairs)
    assert fair["EOpp"] == pytest.approx(mean(lambda a, b: abs(a["TPR"] - b["TPR"])))
    assert fair["EO"] == pytest.approx(mean(lambda a, b: max(abs(a["TPR"] - b["TPR"]), abs(a["FPR"] - b["FPR"]))))
    assert fair["CUAE"] == pytest.approx(mean(lambda a, b: max(abs(a["PPV"] - b["PPV"]), abs(a["NPV"] - b["NPV"]))))
    assert fair["SP"] == pytest.approx(mean(lambda a, b: abs(a["PPOS"] - b["PPOS"])))
    assert fair["BPC"] == pytest.approx(mean(lambda a, b: abs(a["mean_score_pos"] - b["mean_score_pos"])))
    # identities
    assert fair["FDRP"] == pytest.approx(fair["PPVP"]) and fair["FORP"] == pytest.approx(fair["NPVP"])
    assert fair["FNRB"] == pytest.approx(fair["EOpp"])


def test_group_relabelling_and_partitioning_do_not_change_metrics(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 1), rnd.random(), rnd.choice("ABC")) for _ in range(300)]
    df = _scored(spark, rows)
    a = {r["metric"]: r["value"] for r in fairness_from_confusion(confusion_table(df, ["o"])).collect()}
    relab = df.withColumn("o", F.concat(F.lit("x"), F.col("o"))).repartition(7)
    b = {r["metric"]: r["value"] for r in fairness_from_confusion(confusion_table(relab, ["o"])).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_accuracy_metrics(spark):
    rows = [(1, 1, .9, "A"), (1, 0, .2, "A"), (0, 1, .7, "B"), (0, 0, .1, "B"), (1, 1, .8, "B")]
    acc = {r["metric"]: r["value"] for r in accuracy_from_confusion(confusion_table(_scored(spark, rows), ["o"])).collect()}
    assert acc["ACC"] == pytest.approx(3 / 5) and acc["Precision"] == pytest.approx(2 / 3)
    assert acc["Recall"] == pytest.approx(2 / 3) and acc["F1"] == pytest.approx(2 / 3)


def test_mean_abs_pair_diff_closed_form(spark):
    rnd = random.Random(11)
    vals = [(k, rnd.random()) for k in ("a", "b") for _ in range(9)]
    got = {r["k"]: r["mad"] for r in mean_abs_pair_diff(spark.createDataFrame(vals, "k string, x double"),
                                                        ["k"], "x").collect()}
    for k in ("a", "b"):
        xs = [x for kk, x in vals if kk == k]
        ref = sum(abs(p - q) for p, q in itertools.combinations(xs, 2)) / (len(xs) * (len(xs) - 1) / 2)
        assert got[k] == pytest.approx(ref)
