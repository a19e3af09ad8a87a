"""Trees grown by passes over cells: the library's own, row for row."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from equilens.operators import boosting, models, trees
from equilens.spec import AuditSpec

SPEC = AuditSpec("y", ("o",), ("x", "z"), ("c", "k"))


def _rows(spark, n=1500, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c, k, x, z = rnd.choice("abcde"), rnd.randint(1, 4), round(rnd.gauss(0, 30), 1), rnd.randint(0, 9) / 10
        y = int(x / 20 + "abcde".index(c) - k + rnd.gauss(0, 2) > 0)
        rows.append((i, c, k, x, z, "o", y))
    df = spark.createDataFrame(rows, "id int, c string, k int, x double, z double, o string, label_Y int").repartition(5, "id")
    odd = spark.createDataFrame([(n + 1, None, 1, float("nan"), None, None, 1), (n + 2, "new", None, 1e300, 0.1, "o", None)], df.schema)
    return df.where("id % 10 < 7"), df.where("id % 10 >= 7").unionByName(odd)


def _by_id(df):
    got = {r["id"]: (r["label_Y"], r["pred_Y"], r["score_S"], r["o"]) for r in df.collect()}
    assert len(got) == df.count()
    return got


def _same(a, b):
    a, b = _by_id(a), _by_id(b)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][:2] == b[k][:2] and a[k][2] == pytest.approx(b[k][2], abs=1e-9) and a[k][3] == b[k][3], k


def _library(train, test, clf):
    return models.score(Pipeline(stages=[*models.feature_stages(SPEC), clf]).fit(train), test, SPEC, keep=("id",))


@pytest.mark.parametrize("local, depth", [(10 ** 6, 30), (100, 30), (3, 30), (30, 4)])
def test_tree_is_the_librarys(spark, monkeypatch, local, depth):
    """Wherever the part on the driver ends."""
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    train, test = _rows(spark)
    want = _library(train, test, DecisionTreeClassifier(maxDepth=depth, labelCol="label_Y"))
    _same(trees.tree_fit_score(train, test, SPEC, depth, keep=("id",)), want)


def test_driver_holds_only_the_top(spark, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL_ROWS", 200)
    train, test = _rows(spark)
    held, grow_top = [], trees._grow_top
    monkeypatch.setattr(trees, "_grow_top", lambda *a: held.append(grow_top(*a)) or held[-1])
    trees.tree_fit_score(train, test, SPEC, 30).count()
    assert len(held[0][0].split) < 60
    assert trees.tree_fit_score(train, test.where("false"), SPEC, 30).count() == 0


def test_boosted_trees_are_the_librarys(spark, monkeypatch):
    train, test = _rows(spark)
    fit, asked = trees.fit_boosted, []
    monkeypatch.setattr(trees, "fit_boosted", lambda tr, spec, rounds, *a: asked.append((rounds, *a)) or fit(tr, spec, 12, *a))
    _same(models.fit_score(train, test, SPEC, "GBDT", keep=("id",)), _library(train, test, models.classifier("GBDT").setMaxIter(12)))
    assert asked == [(100, 3, 0.1, "label_Y")]


def test_forest(spark):
    train, test = _rows(spark)
    cells, (one,) = trees.fit_forest(train, SPEC, 1, 6, take=9, bag=False)
    want = _library(train, test, DecisionTreeClassifier(maxDepth=6, labelCol="label_Y"))
    _same(trees.score_forest((cells, [one]), test, SPEC, keep=("id",)), want)
    known = test.where("label_Y IS NOT NULL")
    ours, lib = models.fit_score(train, known, SPEC, "RF", keep=("id",)), _library(train, known, models.classifier("RF"))
    j = ours.select("id", "label_Y", F.col("score_S").alias("a")).join(lib.select("id", F.col("score_S").alias("b")), "id")
    r = j.agg(F.corr("a", "b").alias("corr"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("off"), F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    assert r["corr"] > 0.97 and r["off"] < 0.05 and abs(r["a"] - r["b"]) < 0.02
    again = models.fit_score(train, known, SPEC, "RF", keep=("id",))
    assert _by_id(ours) == _by_id(again)


def _stumps(train, test, rounds):
    """AdaBoost as a loop of library fits on reweighted rows."""
    import math
    fe = Pipeline(stages=models.feature_stages(SPEC)).fit(train)
    df, test = fe.transform(train).withColumn("w", F.lit(1.0 / train.count())).cache(), fe.transform(test)
    decision, alphas = F.lit(0.0), []
    for m in range(rounds):
        model = DecisionTreeClassifier(maxDepth=1, labelCol="label_Y", weightCol="w", predictionCol=f"p{m}", rawPredictionCol="r", probabilityCol="q").fit(df)
        bad = (F.col(f"p{m}") != F.col("label_Y")).cast("double")
        out = model.transform(df).drop("r", "q")
        e, t = out.agg(F.sum(F.col("w") * bad), F.sum("w")).first()
        alpha = math.log((t - e) / e)
        df = out.withColumn("w", F.col("w") * F.exp(alpha * bad) / (t - e + e * math.exp(alpha))).localCheckpoint()
        test = model.transform(test).drop("r", "q")
        decision, alphas = decision + alpha * (2 * F.col(f"p{m}") - 1), [*alphas, alpha]
    d = decision / sum(alphas)
    return test.select("id", "label_Y", (d > 0).cast("int").alias("pred_Y"), (1 / (1 + F.exp(-d))).alias("score_S"), "o"), alphas


def test_adaboost_is_a_loop_of_library_stumps(spark):
    train, test = _rows(spark)
    want, alphas = _stumps(train, test, 8)
    model = boosting.fit_adaboost(train, SPEC, n_estimators=8)
    assert model[2] == pytest.approx(alphas, abs=1e-9)
    _same(boosting.score_adaboost(model, test, SPEC, keep=("id",)), want)
    easy = train.withColumn("label_Y", (F.col("c") == "d").cast("int"))
    assert boosting.fit_adaboost(easy, SPEC)[2] == [1.0]


@pytest.mark.parametrize("fit", [lambda d: trees.fit_boosted(d, SPEC, 1, 3, 0.1), lambda d: boosting.fit_adaboost(d, SPEC)])
def test_rows_to_learn_from_are_checked(spark, fit):
    train, test = _rows(spark)
    with pytest.raises(Exception, match="to learn from is"):
        fit(train.unionByName(test))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_forest_goes_on_from_marks(spark, monkeypatch, levels):
    """The forest is that of rows sent from the root at every level, and a pass sends no row further than from the last mark."""
    train, _ = _rows(spark)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(trees, "MARK_LEVELS", 100)
    _, want = trees.fit_forest(train, SPEC, 3, 9)
    monkeypatch.setattr(trees, "MARK_LEVELS", levels)
    grow, asked = trees._grow_forest, []

    def watched(rows, n, depth, marked, sums, search):
        return grow(rows, n, depth, marked, lambda *a: asked.append(a[3]) or sums(*a), search)
    monkeypatch.setattr(trees, "_grow_forest", watched)
    _, got = trees.fit_forest(train, SPEC, 3, 9)
    assert all((a.split == b.split).all() and (a.stats == b.stats).all() for a, b in zip(got, want))
    assert max(asked) <= levels and max(len(a.split) for a in got) > 100
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
