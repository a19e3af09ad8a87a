from pyspark.sql import functions as F

from equilens.operators import discriminant, models
from equilens.operators.encode import binarize_target
from equilens.operators.split import hash_split
from equilens.plans import run as run_ops
from equilens.sources import fixtures as fx
from equilens.spec import AuditSpec

from paths import SF_SMALL

A = fx.AUDIT_SPEC
KEYS = list(fx.LINEITEM_KEY)


def _split(spark):
    lab = binarize_target(fx.audit(spark, SF_SMALL), A.target, "label_Y")
    return hash_split(lab, KEYS, 0.3, 1).cache()


def test_lr_beats_majority_class(spark):
    # the synthetic columns are mutually independent, so no feature predicts another's label;
    # a label that IS a threshold of a feature must be learnt (also checks convergence on raw scales)
    spec = AuditSpec("label_Y", A.protected, ("l_extendedprice", "p_retailprice"), ("l_returnflag",))
    lab = binarize_target(fx.audit(spark, SF_SMALL), "l_extendedprice", "label_Y")
    d = hash_split(lab, KEYS, 0.3, 1)
    scored = models.fit_score(d.where("is_train"), d.where("not is_train"), spec, "LR")
    r = scored.agg(F.avg((F.col("label_Y") == F.col("pred_Y")).cast("double")).alias("acc"),
                   F.avg("label_Y").alias("pos")).first()
    assert r["acc"] >= max(r["pos"], 1 - r["pos"]) + 0.2


def test_closed_form_nb_agrees_with_spark_ml(spark):
    d = _split(spark)
    tr, te = d.where("is_train"), d.where("not is_train")
    num = list(A.numerical)
    ours = discriminant.fit_score(tr, te, num, A.protected, "NB", keep=KEYS).select(*KEYS, F.col("pred_Y").alias("a"))
    spec = A.with_kinds(A.numerical, ())
    ml = models.fit_score(tr, te, spec, "NB", keep=KEYS).select(*KEYS, F.col("pred_Y").alias("b"))
    j = ours.join(ml, KEYS).agg(F.avg((F.col("a") == F.col("b")).cast("double"))).first()[0]
    assert j >= 0.99


def test_run_with_accuracy_enhancement(spark):
    cfg = run_ops.RunConfig(max_iterations=1, use_accuracy_enhancement=True)
    mh, it, fs = run_ops.run(spark, fx.audit(spark, SF_SMALL), A, KEYS, cfg)
    final = fs.first()
    assert final["total_iterations"] == 1
    assert final["termination_reason"] in ("max_iterations", "epsilon_threshold", "accuracy_threshold",
                                           "no_candidate")
    assert mh.where("iteration = 1 and metric = 'ACC'").count() == 1


def _small(spark, n=400, seed=1):
    """x decides the label, c does so weakly, o is numeric (ages)."""
    import random
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = rnd.random()
        rows.append((i, x, rnd.choice("abc") if x < 0.5 else rnd.choice("bcd"), rnd.randint(18, 80), int(x + rnd.gauss(0, 0.1) > 0.5)))
    return spark.createDataFrame(rows, "id int, x double, c string, age int, y int")


SMALL = AuditSpec("y", ("age",), ("x",), ("c",))


def test_one_hot_drops_the_first_level_and_zeroes_unseen(spark):
    from pyspark.ml import Pipeline
    tr = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "c string, x double")
    te = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("new", 1.0), (None, 1.0)], "c string, x double")
    spec = AuditSpec("y", ("o",), ("x",), ("c",))
    fe = Pipeline(stages=models.feature_stages(spec)).fit(tr)
    out = fe.transform(te)
    assert models.vector_width(out, "features") == 3
    got = [r["features"].toArray().tolist() for r in out.collect()]
    assert got == [[1, 0, 0], [1, 0, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]]
    one = Pipeline(stages=models.feature_stages(spec)).fit(tr.where("c = 'a'")).transform(te)
    assert models.vector_width(one, "features") == 1
    audit = fx.audit(spark, SF_SMALL)
    wide = Pipeline(stages=models.feature_stages(A)).fit(audit).transform(audit)
    levels = sum(audit.select(c).distinct().count() - 1 for c in A.categorical)
    assert models.vector_width(wide, "features") == len(A.numerical) + levels


def test_accuracy_threshold_does_not_end_a_run_without_enhancement(spark):
    cfg = run_ops.RunConfig(max_iterations=2, accuracy_gain=-0.9, epsilon_factor=-1.0)
    _, _, fs = run_ops.run(spark, _small(spark), SMALL, ["id"], cfg)
    assert fs.first()["termination_reason"] in ("max_iterations", "no_candidate")
    assert fs.first()["total_iterations"] == 2 or fs.first()["termination_reason"] == "no_candidate"


def test_enhancement_measures_on_train_rows_only(spark):
    """Turning the labels of the test rows around changes nothing in what enhancement decides."""
    cfg = run_ops.RunConfig(use_bias_mitigation=False, use_accuracy_enhancement=True)
    base = run_ops.prepare(_small(spark), SMALL, ["id"], cfg)
    other = base.withColumn("label_Y", F.when(F.col("is_train"), F.col("label_Y")).otherwise(1 - F.col("label_Y")))
    a = run_ops.accuracy_step(base, SMALL, cfg, {}, (), [3.0, 5.0], ["id"])
    b = run_ops.accuracy_step(other, SMALL, cfg, {}, (), [3.0, 5.0], ["id"])
    base.unpersist()
    assert a == b and a[2] is not None


def test_choices_of_importance_and_rebin(spark):
    df = _small(spark)
    for imp, reb in (("a2", "r2"), ("a3", "r3")):
        cfg = run_ops.RunConfig(importance=imp, ae_rebin=reb, use_accuracy_enhancement=True, use_bias_mitigation=False, max_iterations=1)
        _, _, fs = run_ops.run(spark, df, SMALL, ["id"], cfg)
        assert fs.first()["total_iterations"] == 1
    import pytest
    with pytest.raises(ValueError):
        run_ops.run(spark, df, SMALL, ["id"], run_ops.RunConfig(importance="a9", use_accuracy_enhancement=True, use_bias_mitigation=False))


def test_arcsin_mitigation_and_binned_protected(spark, tmp_path):
    df = _small(spark).withColumn("x", F.col("x") * 10 + 1)
    cfg = run_ops.RunConfig(method="arcsin", max_iterations=2)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    mh, it, fs = run_ops.run(spark, df, SMALL, ["id"], cfg, out_dir=str(tmp_path))
    log = {n: spark.read.parquet(f"{tmp_path}/run_log_{n}") for n in ("info", "epsilon", "final")}
    info = log["info"].first()
    assert info["state"] == "completed" and (info["rows"], info["columns"], info["target"]) == (400, 5, "y")
    assert '"method": "arcsin"' in info["configuration"] and info["duration_seconds"] > 0
    assert {r["iteration"] for r in log["epsilon"].collect()} == set(range(fs.first()["total_iterations"] + 1))
    assert log["final"].where("metric = 'Overall_Fairness'").count() == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached


def test_failed_run_leaves_a_record(spark, tmp_path, monkeypatch):
    import pytest

    def broken(*a, **k):
        raise RuntimeError("lost the model")
    monkeypatch.setattr(run_ops, "mitigation_step", broken)
    with pytest.raises(RuntimeError):
        run_ops.run(spark, _small(spark), SMALL, ["id"], run_ops.RunConfig(), out_dir=str(tmp_path))
    info = spark.read.parquet(f"{tmp_path}/run_log_info").first()
    assert info["state"] == "failed" and "lost the model" in info["error"]


def test_chained_merges_apply_to_base_values(spark):
    """With A and B swapped before, merging A into C must match what apply_changes does to the rows."""
    from equilens.functions.transforms import rebin
    from equilens.operators import epsilon as E
    df = spark.createDataFrame([("o1", "A")] * 3 + [("o1", "B")] * 2 + [("o2", "C")] * 4, "o string, c string")
    slots = {"o": ["o1", "o2"]}
    mapping = {"A": "B", "B": "A2", "A2": "C"}
    merged = E.merge_values(E.wide_counts(df, slots, ["c"], False), slots, rebin(F.col("v"), mapping))
    rows = df.withColumn("c", rebin(F.col("c"), mapping))
    want = {(r["c"], r["o"]): r["count"] for r in rows.groupBy("c", "o").count().collect()}
    got = {(r["v"], g): r[c] for r in merged.collect() for g, c in (("o1", "c0_0"), ("o2", "c0_1")) if r[c]}
    assert got == want


def test_next_beta_index():
    from equilens.plans.mitigate import next_index
    assert [next_index(p, "beta_O") for p in (None, "dropped", {"beta_O": 0}, {"beta_Y": 3}, {"beta_O": 2, "beta_Y": 0})] == [0, 0, 1, 1, 3]


def test_r3_rebin_search_returns_a_merge_of_two_values(spark):
    cfg = run_ops.RunConfig(max_iterations=1)
    base = run_ops.prepare(fx.audit(spark, SF_SMALL), A, KEYS, cfg)
    values = {r[0] for r in base.select("l_returnflag").distinct().collect()}
    best, acc = run_ops.ae_rebin_r3(base, A, "l_returnflag", {}, [3.0, 5.0], cfg)
    base.unpersist()
    (old, new), = best.items()
    assert old in values and new in values and old != new and 0.0 < acc <= 1.0


def test_registered_run_goes_as_far_as_the_method(spark, monkeypatch):
    """One iteration was all that the registered runs did."""
    from equilens import queries_core as q
    monkeypatch.setattr(q, "_RUNS", {})
    monkeypatch.setattr(q, "A", SMALL)
    monkeypatch.setattr(q, "KEYS", ["id"])
    rows = [(i, float(i * 7 % 50), "abc"[i % 3], "mn"[i % 2], i * 5 % 11 % 2) for i in range(200)]
    monkeypatch.setattr(q.fx, "audit", lambda *_: spark.createDataFrame(rows, "id int, x double, c string, age string, y int"))
    got = q.q_run_status_loop(spark, "unused").first()
    final = q.q_run_final(spark, "unused").first()
    assert final["max_iterations"] == run_ops.DEFAULT_MAX_ITERATIONS == 2
    assert got["total_iterations"] == 2 or got["termination_reason"] in ("epsilon_threshold", "no_candidate")
    assert len(got["accuracy_series"]) == got["total_iterations"] + 1
