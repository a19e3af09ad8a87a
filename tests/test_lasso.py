"""The lasso path from fold moments against the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.operators import importance as imp


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(0)
    n = 600
    x = np.column_stack([r.normal(5, 1, n), r.normal(0, 1000, n), r.uniform(0, 0.1, n), np.full(n, 3.0)])
    y = (x[:, 0] - 5 + 0.0015 * x[:, 1] + r.normal(0, 0.5, n) > 0).astype(float)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 3.0, 1.0)]
    return spark.createDataFrame(rows, "a double, b double, c double, k double, y double")


def _rows(df):
    fold = F.pmod(F.xxhash64("a", "b", "c", "k", "y", F.lit(0)), F.lit(5))
    got = np.array([list(map(float, r)) for r in df.dropna().select("a", "b", "c", "k", "y", fold).collect()])
    return got[:, :4], got[:, 4], got[:, 5]


def test_path_is_optimal_and_errors_are_those_of_the_rows(table):
    x, y, fold = _rows(table)
    got = imp.lasso_path(*imp.fold_moments(table, ["a", "b", "c", "k"], "y", 5))
    assert len(got["penalties"]) == 100 and got["penalties"][-1] == pytest.approx(got["penalties"][0] * 1e-3)
    # optimality of the chosen coefficients, from the rows: no feature pulls more than the penalty
    w, n = got["coefficients"], len(y)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    pull = xc.T @ (yc - xc @ w) / n
    assert np.all(np.abs(pull) <= got["penalty"] * (1 + 1e-6))
    used = w != 0
    assert used.any() and np.allclose(pull[used], np.sign(w[used]) * got["penalty"], rtol=1e-6) and w[3] == 0
    # errors of some penalties by fitting without a fold and predicting its rows
    for a in (10, 50, 99):
        errors = []
        for f in range(5):
            tr, te = fold != f, fold == f
            xt, yt = x[tr] - x[tr].mean(axis=0), y[tr] - y[tr].mean()
            v = imp._descend(xt.T @ xt, xt.T @ yt, got["penalties"][a] * tr.sum(), np.zeros(4))
            errors.append(np.mean((y[te] - y[tr].mean() - (x[te] - x[tr].mean(axis=0)) @ v) ** 2))
        assert got["errors"][a] == pytest.approx(np.mean(errors), rel=1e-6)
    assert got["penalty"] == got["penalties"][int(np.argmin(got["errors"]))]


def test_importance_table(spark, table):
    df = table.withColumn("g", F.when(F.col("y") > 0, "p").otherwise("n")).withColumn("y", F.col("y").cast("int"))
    got = {r.attr: r.importance for r in imp.lasso_importance(df, ["a", "k"], ["g"], "y").collect()}
    assert got["g"] > 0.5 and got["k"] == 0 and set(got) == {"a", "k", "g"}
    empty = {r.attr: r.importance for r in imp.lasso_importance(df.limit(0), ["a"], [], "y").collect()}
    assert empty == {"a": 0.0}
