"""Permutation importance against its definition, row by row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from equilens.operators import importance as imp


def _joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


class _Sum:
    """A model that predicts 1 where a + 10 b is over 25 (null: 0)."""

    def transform(self, df):
        return df.withColumn("prediction", F.coalesce((F.col("a") + 10 * F.col("b") > 25).cast("double"), F.lit(0.0)))


def test_permutation_matches_its_definition(spark, monkeypatch):
    rows = [(i % 37, i * 7 % 11 if i % 9 else None, i * 3 % 5, int(i % 4 == 0)) for i in range(90)] + [(1, 2, 3, 1)] * 4
    df = spark.createDataFrame(rows, "k int, a int, b int, y int")

    def moved(f, r):
        at = {"a": 1, "b": 2}[f]
        digest = lambda x: hashlib.md5(":".join(["|".join(str(v) for v in x[:3] if v is not None), f, str(r), "0"]).encode()).hexdigest()
        value = {digest(x): x[at] for x in rows}
        order = sorted(value)
        after = {h: value[order[(i + 1) % len(order)]] for i, h in enumerate(order)}
        return [(*x[:at], after[digest(x)], *x[at + 1:]) for x in rows]

    hit = lambda xs: sum((a is not None and a + 10 * b > 25) == bool(y) for _, a, b, y in xs) / len(xs)
    want = {f: hit(rows) - sum(hit(moved(f, r)) for r in range(3)) / 3 for f in ("a", "b")}
    seen = []
    count = lambda df: seen.append(_joins(df).count("Exchange hashpartitioning"))
    real = _Sum.transform
    monkeypatch.setattr(_Sum, "transform", lambda self, d: (count(d), real(self, d))[1])
    got = {r["attr"]: r["importance"] for r in imp.permutation_importance(_Sum(), df, ["a", "b"], ["k"], "y", 3).collect()}
    assert got == pytest.approx(want)
    assert max(seen) <= 2, "the stacked rows are exchanged once, beside the few slices"


def test_permutation_of_a_single_content_and_of_nothing(spark):
    schema = "k int, a int, b int, y int"
    one = imp.permutation_importance(_Sum(), spark.createDataFrame([(1, 2, 3, 1)] * 3, schema), ["a"], ["k"], "y", 2)
    assert [tuple(r) for r in one.collect()] == [("a", 0.0)]
    assert imp.permutation_importance(_Sum(), spark.createDataFrame([], schema), ["a"], ["k"], "y", 2).count() == 0


def _fitted(spark):
    from equilens.operators import models
    from equilens.spec import AuditSpec
    rows = [(i, i * 37 % 101 / 7 if i % 11 else None, "pqr"[i * i % 3] if i % 13 else None, i * 29 % 5, int(i * 37 % 101 + 30 * (i * i % 3) + i % 17 > 70)) for i in range(600)]
    rows += [rows[5]] * 40 + [(601, float("inf"), "s", 9, 1), (602, float("nan"), "q", 2, None), (603, 2.0, "new", 1, 3)]
    df = spark.createDataFrame(rows, "k int, x double, c string, d int, y int")
    train = df.where("k < 400 and x is not null")
    return models.fit(train, AuditSpec("y", (), ("x",), ("c", "d")), "LR", "y"), df.where("k >= 300 or k = 5")


class _Opaque:
    """Hides what kind of model it is."""

    def __init__(self, model):
        self.model = model

    def transform(self, df):
        return self.model.transform(df)


@pytest.mark.parametrize("slice_rows, pass_rows, block_rows", [(10 ** 6, 10 ** 7, 16_384), (37, 700, 50), (3, 1, 7)])
def test_linear_model_is_scored_from_packed_rows(spark, monkeypatch, slice_rows, pass_rows, block_rows):
    """No row is copied for a permutation, and the importance is that of the stacked rows."""
    model, test = _fitted(spark)
    args = (["x", "c", "d"], ["k"], "y", 2 if slice_rows > 3 else 1, 7)
    want = {r["attr"]: r["importance"] for r in imp.permutation_importance(_Opaque(model), test, *args).collect()}
    monkeypatch.setattr(imp, "_stacked_accuracies", None)
    for name, v in (("SLICE_ROWS", slice_rows), ("PASS_ROWS", pass_rows)):
        monkeypatch.setattr(imp.permuted, name, v)
    monkeypatch.setattr(imp.permuted, "BLOCK_ROWS", block_rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block_rows))
    try:
        got = {r["attr"]: r["importance"] for r in imp.permutation_importance(model, test, *args).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(want, abs=1e-12) and any(abs(v) > 0.01 for v in got.values())
    assert imp.permutation_importance(model, test.where("false"), *args).count() == 0


def test_stacked_permutations_go_in_passes(spark, monkeypatch):
    model, test = _fitted(spark)
    args = (["x", "c"], ["k"], "y", 2, 0)
    want = {r["attr"]: r["importance"] for r in imp.permutation_importance(_Opaque(model), test, *args).collect()}
    seen, real = [], imp._stacked_accuracies
    monkeypatch.setattr(imp, "_stacked_accuracies", lambda *a: seen.append(len(a[4])) or real(*a))
    monkeypatch.setattr(imp, "STACKED_ROWS", 3 * test.count())
    got = {r["attr"]: r["importance"] for r in imp.permutation_importance(_Opaque(model), test, *args).collect()}
    assert got == pytest.approx(want, abs=1e-12) and seen == [3, 1]
