"""Batched Newton steps: against the library fit, a dense fit, and for merges one fit each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import models, newton
from equilens.plans import run as run_ops
from equilens.spec import AuditSpec

SPEC = AuditSpec("y", ("o",), ("x",), ("c", "k"))


def _rows(spark, n=600):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        c, k, x = rnd.choice("abcd"), rnd.randint(1, 3), rnd.gauss(0, 30)
        rows.append((i, c, k, x, "o", int(x / 20 + ("abcd".index(c)) - k + rnd.gauss(0, 1) > 0), i % 10 < 7))
    return spark.createDataFrame(rows, "id int, c string, k int, x double, o string, label_Y int, is_train boolean")


def _dense(table, design, slot):
    """Gradient descent's fixed point by plain Newton on a dense matrix, one row at a time."""
    at = lambda r: [r["x"]] + [float(str(r[c]) == v) for c, vs in design.levels.items() for v in vs] + [1.0]
    full, y = np.array([at(r) for r in table]), np.array([r["label_Y"] for r in table], float)
    x = np.zeros((len(full), slot[-1] + 1))
    for i, s in enumerate(slot):
        if s >= 0:
            x[:, s] += full[:, i]
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 0
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w, x, y


def test_coefficients_match_dense_and_library(spark):
    df = _rows(spark)
    design = newton.Design(("x",), newton.levels_of(df, ("c", "k")))
    slot = newton.slots(design)
    w = newton.fit(design.rows(df.repartition(7), "label_Y"), design, [slot])[0]
    want, _, _ = _dense(df.collect(), design, slot)
    assert np.allclose(w, want, atol=1e-6)
    lib = models.fit(df, SPEC, "LR1000").stages[-1]
    assert np.allclose(sorted(w[:-1]), sorted(lib.coefficients.toArray()), atol=2e-2) and abs(w[-1] - lib.intercept) < 2e-2


@pytest.mark.parametrize("passes", [1, 10 ** 7])
def test_merges_equal_one_fit_each(spark, monkeypatch, passes):
    monkeypatch.setattr(newton, "PASS_DOUBLES", passes)          # one variant a pass, or all in one
    df = _rows(spark)
    got = newton.merge_accuracies(df.where("is_train"), df.where("not is_train"), ("x",), ("c", "k"), "c", "label_Y", {"d": "a"})
    assert [g[:2] for g in got] == [("a", "b"), ("a", "c"), ("b", "c")]
    for old, new, acc in got:
        merged = df.replace("d", "a", ["c"]).replace(old, new, ["c"])
        train, test = merged.where("is_train").collect(), merged.where("not is_train").collect()
        design = newton.Design(("x",), newton.levels_of(merged, ("c", "k")))
        slot = newton.slots(design)
        w, _, _ = _dense(train, design, slot)
        _, x, y = _dense(test, design, slot)
        assert acc == pytest.approx(np.mean((x @ w > 0) == (y > 0)))


def test_odd_rows(spark):
    df = _rows(spark)
    odd = spark.createDataFrame([(1000, None, 1, 1.0, "o", 1, True), (1001, "a", None, None, "o", 1, True), (1002, "a", 1, float("nan"), "o", 0, True),
                                 (1003, "a", 1, 1.0, "o", None, True), (1004, "zz", 2, 0.0, "o", 1, False)], df.schema)
    both = df.unionByName(odd)
    clean = df.unionByName(odd.where("id in (1000, 1004)"))
    args = (("x",), ("c", "k"), "c", "label_Y")
    a, b = (newton.merge_accuracies(d.where("is_train"), d.where("not is_train"), *args) for d in (both, clean))
    assert a == b and ("a", "zz") in [g[:2] for g in a]           # a value of the held-out rows only is a value too
    empty = df.where("false")
    assert newton.merge_accuracies(empty, df, *args)[0][2] == pytest.approx(df.where("label_Y = 0").count() / df.count())
    assert newton.merge_accuracies(df, empty, *args)[0][2] is None
    assert newton.merge_accuracies(empty, empty, *args) == []
    table = {(r["term"], r["level"]): r["coefficient"] for r in newton.coefficient_table(empty, ("x",), ("c",), "label_Y").collect()}
    assert table == {("x", None): 0.0, ("", None): 0.0}


def test_separable_rows_converge(spark):
    df = spark.range(2000).select((F.col("id") * 1000.0 + 1e6).alias("x"), (F.col("id") > 900).cast("int").alias("label_Y"))
    design = newton.Design(("x",), {})
    slot = newton.slots(design)
    w = newton.fit(design.rows(df, "label_Y"), design, [slot])
    assert newton.accuracies(design.rows(df, "label_Y"), design, [slot], w)[0] > 0.999


def test_r3_picks_the_best_trial(spark):
    df = _rows(spark)
    cfg = run_ops.RunConfig()
    trials = run_ops.rebin_trials(df, SPEC, "k", {}, [3.0, 5.0], cfg)
    best, acc = run_ops.ae_rebin_r3(df, SPEC, "k", {}, [3.0, 5.0], cfg)
    assert acc == max(t[2] for t in trials) and all(isinstance(v, int) for kv in best.items() for v in kv)
