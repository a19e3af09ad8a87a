"""Wide joins run once, and no join by a few keys exchanges the rows by them."""

import pytest
from pyspark.sql import functions as F

from equilens import queries_core as q
from equilens.operators import pairs, split
from equilens.plans import run as runs

from paths import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def joined(spark):
    """Audit rows as a join gives them."""
    a = spark.range(60).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_partkey"), F.lit(2).alias("l_suppkey"),
        *[(F.col("id") * (i + 3) % 17).cast("double").alias(c) for i, c in enumerate(q.A.numerical)],
        *[(F.col("id") % (i + 2)).cast("string").alias(c) for i, c in enumerate(q.A.categorical)],
        *[(F.col("id") % 3).cast("string").alias(c) for c in q.A.protected])
    y = spark.range(60).select(F.col("id").alias("l_orderkey"), (F.col("id") * 7 % 50).cast("double").alias(q.A.target))
    return a.join(y, "l_orderkey")


def test_audit_rows_are_joined_once(spark, joined, monkeypatch):
    monkeypatch.setattr(q.fx, "audit", lambda *_: joined)
    for made in (q.audit_split, q._audit_labeled):
        got = made(spark, "unused")
        assert "Join" not in _plan(got) and got.count() == 60
    base = runs.prepare(joined, q.A, q.KEYS, runs.RunConfig())
    assert "Join" not in _plan(base) and "median" not in _plan(base) and base.count() == 60


@pytest.fixture
def no_small_tables(spark):
    """As if every side of a join were estimated too large for a broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in zip(names, old):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stratified_split_joins_classes_by_broadcast(spark, no_small_tables):
    df = spark.range(200).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 2).alias("y"))
    got = split.stratified_split(df, ["id"], "y", 0.3, 42)
    assert "SortMergeJoin" not in _joins(got)
    tests = {r["y"]: r["n"] for r in got.where("NOT is_train").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert tests == {None: 6, 0: 24, 1: 30}


def test_totals_join_attributes_by_broadcast(spark, no_small_tables):
    df = spark.range(40).select((F.col("id") % 2).cast("string").alias("p"), (F.col("id") % 5).alias("x"))
    slots = {"p": ["0", "1"]}
    wide = pairs.with_totals(pairs.wide_counts(df, slots, ["x"], True), slots)
    assert "SortMergeJoin" not in _joins(wide) and wide.count() == 5


def test_audit_rows_are_joined_without_a_sort(spark, no_small_tables):
    plan = _joins(q.fx.audit(spark, SF_SMALL))
    assert plan.count("ShuffledHashJoin") == 3 and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_mutual_information_writes_only_what_it_counts(spark, joined, monkeypatch):
    seen, real = [], q.imp_ops.mutual_information
    monkeypatch.setattr(q.fx, "audit", lambda *_: joined)
    monkeypatch.setattr(q.imp_ops, "mutual_information", lambda df, *a: seen.append(df.columns) or real(df, *a))
    assert q.q_mi(spark, "unused").count() == len(q.A.features)
    assert set(seen[0]) == {*q.A.features, q.A.target, "label_Y"}
