"""Query registrations: metrics, profile, encoding, splits, epsilon, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from equilens.operators import confusion as conf_ops
from equilens.operators import fairness as fair_ops
from equilens.registry import finalize, register
from equilens.sources import fixtures as fx
from equilens.spec import FAIRNESS_METRICS

P3 = list(fx.SCORED_PROTECTED)


def _conf(spark, sf):
    return conf_ops.confusion_table(fx.scored(spark, sf), P3)


# ---- step 1: confusion, accuracy and fairness metrics ---------------------
@register("confusion_by_group")
def q_confusion(spark, sf):
    return finalize(_conf(spark, sf))


@register("accuracy_metrics")
def q_accuracy(spark, sf):
    return finalize(fair_ops.accuracy_from_confusion(_conf(spark, sf)))


def _fair_one(metric):
    def q(spark, sf):
        return finalize(fair_ops.fairness_from_confusion(_conf(spark, sf), [metric]))
    return q


for _m in FAIRNESS_METRICS:
    register(f"fairness_{_m.lower()}")(_fair_one(_m))


@register("fairness_all")
def q_fairness_all(spark, sf):
    return finalize(fair_ops.fairness_from_confusion(_conf(spark, sf)))


@register("overall_fairness")
def q_overall_fairness(spark, sf):
    return finalize(fair_ops.overall_fairness(fair_ops.fairness_from_confusion(_conf(spark, sf))))


@register("performance_matrix")
def q_perf_matrix(spark, sf):
    return finalize(fair_ops.performance_matrix(_conf(spark, sf)))


@register("ratio_mode")
def q_ratio_mode(spark, sf):
    c = _conf(spark, sf)
    parts = [fair_ops.disparity(c, r, m) for r in ("TPR", "FPR", "PPV", "ACC") for m in ("difference", "ratio")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finalize(out)


# ---- step 2: profile and data-level bias ------------------------------------
from equilens.operators import profile as prof_ops  # noqa: E402

PROFILE_COLS = list(fx.AUDIT_SPEC.features) + list(fx.AUDIT_SPEC.protected) + [fx.AUDIT_SPEC.target, "all_null"]
BIG = {"min": 4, "max": 4, "mean": 4, "std": 4}


@register("column_profile")
def q_column_profile(spark, sf):
    return finalize(prof_ops.column_profile(fx.nulls(spark, sf), PROFILE_COLS), scales=BIG)


@register("value_counts_top10")
def q_value_counts(spark, sf):
    a = fx.audit(spark, sf)
    return prof_ops.top_value_counts(a, list(fx.AUDIT_SPEC.categorical) + list(fx.AUDIT_SPEC.protected))


@register("target_distribution")
def q_target_distribution(spark, sf):
    return prof_ops.target_distribution(fx.docs(spark, sf), "toxic")


@register("histogram")
def q_histogram(spark, sf):
    return finalize(prof_ops.histogram(fx.audit(spark, sf), fx.AUDIT_SPEC.numerical), scale=4)


@register("group_positive_rates")
def q_group_rates(spark, sf):
    return finalize(prof_ops.group_positive_rates(fx.docs(spark, sf), "toxic", fx.DOCS_SPEC.protected))


@register("data_bias")
def q_data_bias(spark, sf):
    r = prof_ops.group_positive_rates(fx.docs(spark, sf), "toxic", fx.DOCS_SPEC.protected)
    return finalize(prof_ops.data_bias(r))


@register("data_bias_combined")
def q_data_bias_combined(spark, sf):
    r = prof_ops.group_positive_rates(fx.docs(spark, sf), "toxic", fx.DOCS_SPEC.protected)
    return finalize(prof_ops.data_bias_combined(prof_ops.data_bias(r)).drop("individual"))


@register("dataset_summary")
def q_dataset_summary(spark, sf):
    return finalize(prof_ops.dataset_summary(fx.docs(spark, sf), "toxic", fx.DOCS_SPEC.features))


# ---- step 3: kinds, binning, encoding, target ---------------------------------
from equilens.operators import encode as enc_ops  # noqa: E402

KEYS = list(fx.LINEITEM_KEY)
NULLS_ALL = ["l_orderkey", "l_partkey", "l_suppkey"] + PROFILE_COLS


@register("infer_kinds_loader")
def q_kinds_loader(spark, sf):
    return enc_ops.infer_kinds(fx.nulls(spark, sf), NULLS_ALL, rule="loader")


@register("infer_kinds_profile")
def q_kinds_profile(spark, sf):
    return enc_ops.infer_kinds(fx.nulls(spark, sf), NULLS_ALL, rule="profile")


@register("bin_median")
def q_bin_median(spark, sf):
    a = fx.audit(spark, sf).select(*KEYS, "o_totalprice")
    return enc_ops.bin_median(a, "o_totalprice", "bin")


@register("bin_quartile")
def q_bin_quartile(spark, sf):
    a = fx.audit(spark, sf).select(*KEYS, "l_quantity", "p_retailprice")
    return enc_ops.bin_quartile(enc_ops.bin_quartile(a, "l_quantity", out="bin_qty"), "p_retailprice", out="bin_price")


@register("bin_equal_width")
def q_bin_equal_width(spark, sf):
    a = fx.nulls(spark, sf).select(*KEYS, "l_discount")
    return enc_ops.bin_equal_width(a, "l_discount", 4, out="bin")


CAT = list(fx.AUDIT_SPEC.categorical)


@register("encoding_dictionary")
def q_encoding_dictionary(spark, sf):
    return enc_ops.encoding_dictionary(fx.nulls(spark, sf), CAT).drop("raw")


@register("label_encode")
def q_label_encode(spark, sf):
    n = fx.nulls(spark, sf).select(*KEYS, *[c for c in CAT if c != "l_linenumber"],
                                   F.col("l_linenumber").alias("linenumber_code"))
    return enc_ops.label_encode(n, [c for c in CAT if c != "l_linenumber"] + ["linenumber_code"])


@register("inverse_encode")
def q_inverse_encode(spark, sf):
    n = fx.nulls(spark, sf).select(*KEYS, "l_returnflag", "p_type")
    d = enc_ops.encoding_dictionary(n, ["l_returnflag", "p_type"])
    e = enc_ops.label_encode(n, ["l_returnflag", "p_type"], d)
    return enc_ops.inverse_encode(enc_ops.inverse_encode(e, "l_returnflag", d), "p_type", d)


@register("binarize_target")
def q_binarize_target(spark, sf):
    a = fx.audit(spark, sf).select(*KEYS, "o_totalprice")
    return enc_ops.binarize_target(a, "o_totalprice")


@register("binarize_target_binary")
def q_binarize_target_binary(spark, sf):
    return enc_ops.binarize_target(fx.docs(spark, sf).select("doc_id", "toxic"), "toxic")


@register("binarize_target_nulls")
def q_binarize_target_nulls(spark, sf):
    """A numeric target with nulls: they take the median."""
    return enc_ops.binarize_target(fx.nulls(spark, sf).select(*KEYS, "l_discount"), "l_discount")


@register("binarize_target_null_class")
def q_binarize_target_null_class(spark, sf):
    """A string target whose nulls are a class of their own, 'NaN'."""
    status = fx.table(spark, sf, "lineitem").select(*KEYS, F.expr("nullif(l_linestatus, 'F')").alias("l_linestatus"))
    return enc_ops.binarize_target(status, "l_linestatus")


# ---- step 4: splits, samples, subgroup filter ------------------------------------
from equilens.operators import split as split_ops  # noqa: E402


@register("hash_split")
def q_hash_split(spark, sf):
    return split_ops.hash_split(fx.scored(spark, sf).select(*KEYS), KEYS, 0.3, 1)


@register("hash_sample")
def q_hash_sample(spark, sf):
    return split_ops.hash_sample(fx.scored(spark, sf).select(*KEYS, "label_Y"), KEYS, 0.5, 0)


@register("stratified_split")
def q_stratified_split(spark, sf):
    return split_ops.stratified_split(fx.scored(spark, sf).select(*KEYS, "label_Y"), KEYS, "label_Y", 0.3, 42)


@register("subgroup_filter")
def q_subgroup_filter(spark, sf):
    a = fx.audit(spark, sf).select(*KEYS, "c_mktsegment", "l_returnflag", "l_quantity")
    return split_ops.subgroup_filter(a, {"c_mktsegment": "BUILDING", "l_returnflag": "R"})


# ---- step 5: epsilon (bias concentration) ---------------------------------------
from equilens.operators import epsilon as eps_ops  # noqa: E402
from equilens.spec import EpsilonConfig  # noqa: E402

A = fx.AUDIT_SPEC
A_NUM = A.with_kinds(A.numerical, ())
A_CAT = A.with_kinds((), A.categorical)
NUMC = {"s": 4}


def _s_query(spec, cfg, scales=None):
    def q(spark, sf):
        s = eps_ops.difference_table(fx.audit(spark, sf), spec, cfg)
        return finalize(s, scales=scales)
    return q


register("diff_num_a")(_s_query(A_NUM, EpsilonConfig(num="num-a")))
register("diff_num_b")(_s_query(A_NUM, EpsilonConfig(num="num-b")))
register("diff_num_c")(_s_query(A_NUM, EpsilonConfig(num="num-c"), NUMC))
register("diff_cat_a")(_s_query(A_CAT, EpsilonConfig(cat="cat-a")))
register("diff_cat_b")(_s_query(A_CAT, EpsilonConfig(cat="cat-b")))
for _sc in ("min", "mean", "sigma"):
    # ratios over a near-zero minimum amplify summation-order noise: compare at 4 decimals
    register(f"diff_scaled_{_sc}")(_s_query(A, EpsilonConfig(scale=_sc), {"s": 4}))


def _loo(how):
    def q(spark, sf):
        return finalize(eps_ops.leave_one_out(eps_ops.difference_table(fx.audit(spark, sf), A), how))
    return q


register("subset_loo_d1a")(_loo("d1A"))
register("subset_loo_d1b")(_loo("d1B"))


@register("attr_distance")
def q_attr_distance(spark, sf):
    return finalize(eps_ops.attribute_distance(eps_ops.difference_table(fx.audit(spark, sf), A)))


@register("epsilon")
def q_epsilon(spark, sf):
    return finalize(eps_ops.epsilon(fx.audit(spark, sf), A))


@register("epsilon_num_b_cat_b")
def q_epsilon_b(spark, sf):
    return finalize(eps_ops.epsilon(fx.audit(spark, sf), A, EpsilonConfig(num="num-b", cat="cat-b")))


@register("max_epsilon")
def q_max_epsilon(spark, sf):
    return finalize(eps_ops.max_epsilon(eps_ops.epsilon(fx.audit(spark, sf), A)))


@register("mean_epsilon")
def q_mean_epsilon(spark, sf):
    return finalize(eps_ops.mean_epsilon(eps_ops.epsilon(fx.audit(spark, sf), A)))


# ---- step 6: transforms, beta streams, re-bins, validity ---------------------------
from equilens.functions.beta import beta_stream  # noqa: E402
from equilens.functions.transforms import multi_transform  # noqa: E402
from equilens.operators import transform as tr_ops  # noqa: E402

D4A = [2.0 * i + 3 for i in range(10)]       # the sequences d4A and d4B (see beta_table)
D4B = [1 / b for b in D4A]


def _audit_cols(spark, sf, *cols):
    return fx.audit(spark, sf).select(*KEYS, *cols)


@register("transform_poly")
def q_transform_poly(spark, sf):
    a = _audit_cols(spark, sf, "l_quantity", "l_discount")
    return finalize(tr_ops.apply_changes(a, A, {"l_quantity": {"beta_O": 0}, "l_discount": {"beta_O": 1}}, D4B))


@register("transform_log")
def q_transform_log(spark, sf):
    a = _audit_cols(spark, sf, "l_quantity", "l_discount")
    return finalize(tr_ops.apply_changes(a, A, {"l_quantity": {"beta_O": 0}, "l_discount": {"beta_O": 2}},
                                         D4A, method="log"))


@register("transform_arcsin")
def q_transform_arcsin(spark, sf):
    a = _audit_cols(spark, sf, "l_quantity")
    return finalize(tr_ops.apply_changes(a, A, {"l_quantity": {"beta_O": 0}}, D4A, method="arcsin"))


@register("transform_t2")
def q_transform_t2(spark, sf):
    a = _audit_cols(spark, sf, "l_quantity")
    return finalize(tr_ops.apply_changes(a, A, {"l_quantity": {"beta_O": 2}}, D4B, multi="t2"))


@register("transform_t3")
def q_transform_t3(spark, sf):
    a = _audit_cols(spark, sf, "l_quantity")
    return finalize(tr_ops.apply_changes(a, A, {"l_quantity": {"beta_O": 2}}, D4B, multi="t3"))


@register("transform_blend")
def q_transform_blend(spark, sf):
    a = _audit_cols(spark, sf, "l_quantity", "l_discount", "l_tax")
    ch = {"l_quantity": {"beta_O": 0, "beta_Y": 1}, "l_discount": {"beta_O": -1, "beta_Y": 0}, "l_tax": "dropped"}
    return finalize(tr_ops.apply_changes(a, A, ch, D4B))


@register("rebin_chain")
def q_rebin_chain(spark, sf):
    a = _audit_cols(spark, sf, "l_returnflag").withColumn("linenumber", F.col("l_linenumber"))
    spec = A.with_kinds(A.numerical, tuple(A.categorical) + ("linenumber",))
    return tr_ops.apply_changes(a, spec, {"linenumber": {3: 1, 1: 0}, "l_returnflag": {"R": "A", "A": "F"}}, D4A)


VALIDITY_CANDIDATES = [
    ("l_quantity", {"beta_O": 0}),
    ("l_extendedprice", {"beta_O": 3}),
    ("l_quantity", {"beta_O": 10}),
    ("l_discount", {"beta_O": 1, "beta_Y": 2}),
    ("l_returnflag", {"R": "A", "A": "N"}),
    ("l_returnflag", {"R": "A"}),
    ("p_type", {"PROMO": "SMALL"}),
]


@register("transform_validity")
def q_transform_validity(spark, sf):
    return tr_ops.validity(fx.audit(spark, sf), A, VALIDITY_CANDIDATES, D4A, multi="t2")


def _stream_query(mode, order=0):
    # integer betas up to 21 overflow the significant digits of x^beta: use the log transform there
    method = "log" if mode == "d4A" else "poly"

    def q(spark, sf):
        s = beta_stream(mode, order=order, spark=spark)
        a = _audit_cols(spark, sf, "l_quantity")
        x = F.col("l_quantity").cast("double")
        return finalize(a.select(*KEYS, "l_quantity", multi_transform(x, s, 0, method).alias("t_first"),
                                 multi_transform(x, s, len(s) - 1, method).alias("t_last"),
                                 F.lit(len(s)).cast("long").alias("stream_len")))
    return q


for _mode in ("d4A", "d4B", "E2", "E3", "E4", "E5", "E7", "E8"):
    register(f"beta_stream_{_mode.lower()}")(_stream_query(_mode))
register("beta_stream_e2_rising")(_stream_query("E2", 1))
register("beta_stream_e5_falling")(_stream_query("E5", -1))


# ---- step 7: re-bin choices and importance -------------------------------------
from equilens.operators import importance as imp_ops  # noqa: E402
from equilens.operators import rebin as rb_ops  # noqa: E402
from equilens.operators.sizing import written  # noqa: E402


def _audit_labeled(spark, sf, columns=("*",)):
    """The audit rows with their label; joined once and written, as fits and quantiles read them many times."""
    return enc_ops.binarize_target(written(fx.audit(spark, sf).select(*columns), "audit"), A.target, "label_Y")


@register("bm_rebin_candidates")
def q_bm_cands(spark, sf):
    return finalize(rb_ops.bm_rebin_candidates(fx.audit(spark, sf), A.protected, A.categorical))


@register("bm_rebin_choice")
def q_bm_choice(spark, sf):
    return finalize(rb_ops.bm_rebin_choice(rb_ops.bm_rebin_candidates(fx.audit(spark, sf), A.protected,
                                                                      A.categorical)))


@register("ae_rebin_r1")
def q_ae_r1(spark, sf):
    return rb_ops.ae_rebin_r1(_audit_labeled(spark, sf), "label_Y", A.categorical)


@register("ae_rebin_r2")
def q_ae_r2(spark, sf):
    return rb_ops.ae_rebin_r2(fx.audit(spark, sf), A.categorical)


@register("ae_rebin_r3")
def q_ae_r3(spark, sf):
    """Every merge of two line numbers: accuracy of the refitted model, all merges fitted side by side."""
    from equilens.operators import newton
    d = audit_split(spark, sf)
    rows = newton.merge_accuracies(d.where("is_train"), d.where("not is_train"), (), ("l_linenumber",), "l_linenumber", "label_Y")
    return finalize(spark.createDataFrame(rows, "from_value string, to_value string, accuracy double"))


@register("lr_coefficients")
def q_lr_coefficients(spark, sf):
    """Logistic regression by Newton steps over a number and a category."""
    from equilens.operators import newton
    d = audit_split(spark, sf).where("is_train").withColumn("price", F.col("l_extendedprice") / 1000)
    return finalize(newton.coefficient_table(d, ("price",), ("l_returnflag",), "label_Y"))


MI_COLUMNS = (*A.features, A.target)


@register("mi_importance")
def q_mi(spark, sf):
    return finalize(imp_ops.mutual_information(_audit_labeled(spark, sf, MI_COLUMNS), "label_Y", A.numerical, A.categorical))


@register("pick_lowest_importance")
def q_pick_lowest(spark, sf):
    mi = imp_ops.mutual_information(_audit_labeled(spark, sf, MI_COLUMNS), "label_Y", A.numerical, A.categorical)
    return finalize(imp_ops.pick_lowest(mi, exclude=["l_returnflag"]))


# ---- step 8: classifiers, evaluation ----------------------------------------------
from equilens.operators import models as ml_ops  # noqa: E402

CLASSIFIERS = ("LR", "DT", "RF", "GBDT", "NB", "SVM", "MLP")


def audit_split(spark, sf):
    return split_ops.hash_split(_audit_labeled(spark, sf), KEYS, 0.3, 1)


def _score_query(name):
    def q(spark, sf):
        d = audit_split(spark, sf)
        return finalize(ml_ops.fit_score(d.where("is_train"), d.where("not is_train"), A, name, keep=KEYS))
    return q


for _c in CLASSIFIERS:
    register(f"score_{_c.lower()}")(_score_query(_c))


@register("one_hot")
def q_one_hot(spark, sf):
    """Dummy columns of the categorical features (first level left out): set slots of every row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    a = written(fx.audit(spark, sf).select(*dict.fromkeys([*KEYS, *A.categorical])), "audit")
    spec = A.with_kinds((), A.categorical)
    out = Pipeline(stages=ml_ops.feature_stages(spec)).fit(a).transform(a)
    width = ml_ops.vector_width(out, "features")
    x = vector_to_array("features")
    at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) == 1)
    return out.select(*KEYS, at.alias("slots"), F.lit(width).cast("long").alias("width"))


@register("evaluate_lr")
def q_evaluate_lr(spark, sf):
    d = audit_split(spark, sf)
    scored = ml_ops.fit_score(d.where("is_train"), d.where("not is_train"), A, "LR")
    conf = conf_ops.confusion_table(scored, A.protected)
    acc = fair_ops.accuracy_from_confusion(conf).select("metric", F.lit(None).cast("string").alias("protected"),
                                                        "value")
    return finalize(acc.unionByName(fair_ops.fairness_from_confusion(conf)))


# ---- step 9: mitigation step ------------------------------------------------------------
@register("bm_iteration")
def q_bm_iteration(spark, sf):
    import json

    from equilens.plans.mitigate import mitigation_step
    base = fx.audit(spark, sf).select(*A.protected, *A.features).persist()
    r = mitigation_step(base, A, {}, D4A)
    base.unpersist()
    row = (r.protected, r.attr, r.attempts, r.success, r.epsilon_before, r.epsilon_after,
           json.dumps(r.changes, sort_keys=True, default=str))
    return spark.createDataFrame([row], "protected string, attr string, attempts int, success boolean, "
                                        "epsilon_before double, epsilon_after double, changes string")


# ---- step 9: the run loop and its history views -----------------------------------
from equilens.plans import run as run_ops  # noqa: E402

_RUNS: dict = {}


def _run_once(spark, sf):
    """A whole run on the audit table, up to the method's own bound (memoised per session and scale)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = run_ops.run(spark, fx.audit(spark, sf), A, KEYS)
    return _RUNS[key]


@register("run_history")
def q_run_history(spark, sf):
    return finalize(_run_once(spark, sf)[0].drop("run_id"))


def _scored_history(spark, sf):
    """A run history over the scored rows: iteration = l_linenumber, accuracy (no protected attribute),
    positive prediction rate for each segment, and their largest as max_epsilon."""
    s = fx.scored(spark, sf).select(F.col("l_linenumber").alias("iteration"), "c_mktsegment", "label_Y", "pred_Y")
    none = F.lit(None).cast("string")
    acc = s.groupBy("iteration").agg(F.avg((F.col("label_Y") == F.col("pred_Y")).cast("double")).alias("value"))
    rate = s.groupBy("iteration", "c_mktsegment").agg(F.avg("pred_Y").alias("value"))
    top = rate.groupBy("iteration").agg(F.max("value").alias("value"))
    rows = [acc.select("iteration", F.lit("ACC").alias("metric"), none.alias("protected"), "value"),
            rate.select("iteration", F.lit("PPOS").alias("metric"), F.col("c_mktsegment").alias("protected"), "value"),
            top.select("iteration", F.lit("max_epsilon").alias("metric"), none.alias("protected"), "value")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("run_id", F.lit("scored"))


@register("metric_series")
def q_metric_series(spark, sf):
    return finalize(run_ops.metric_series(_scored_history(spark, sf)).drop("run_id"))


@register("before_after")
def q_before_after(spark, sf):
    return finalize(run_ops.before_after(_scored_history(spark, sf)).drop("run_id"))


@register("run_final_state")
def q_run_final(spark, sf):
    return finalize(_run_once(spark, sf)[2].drop("run_id"))


@register("rows_changed")
def q_rows_changed(spark, sf):
    ch = {"l_quantity": {"beta_O": 0}, "l_returnflag": {"R": "A"}, "l_tax": "dropped"}
    return run_ops.rows_changed(fx.audit(spark, sf), A, ch, D4B)


# ---- step 11: streaming monitor ----------------------------------------------------
from equilens.session import ensure_checkpoint_dir  # noqa: E402
from equilens.streaming import monitor as mon  # noqa: E402

_STREAMS: dict = {}


FEED_PARTS = 5


def _feed(spark, sf, path):
    """Write the events in time order as ``FEED_PARTS`` deliveries; yields the number of files of each once it is there.

    Every task writes what its part of the table has of a delivery, so none holds a whole delivery.
    """
    ev = spark.read.parquet(f"{sf}/events.parquet")
    lo, hi = ev.agg(F.min("ts").cast("timestamp").cast("double"), F.max("ts").cast("timestamp").cast("double")).first()
    part = F.least(F.floor((F.col("ts").cast("timestamp").cast("double") - lo) / max(hi - lo, 1.0) * FEED_PARTS), F.lit(FEED_PARTS - 1))
    for i in range(FEED_PARTS):
        ev.where(part == i).write.parquet(f"{path}/delivery{i}")
        yield len(spark.read.schema(ev.schema).parquet(f"{path}/delivery{i}").inputFiles())


def _stream_once(spark, sf, window="1 day", slide=None):
    """Run the monitor over the events table as a file stream (availableNow) into the shared scratch dir."""
    import uuid
    key = (id(spark), sf, window, slide)
    if key not in _STREAMS:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/monitor-{uuid.uuid4().hex[:8]}"
        schema = spark.read.parquet(f"{sf}/events.parquet").schema
        # one micro-batch takes all files of a delivery; the checkpoint carries windows and watermark on
        for files in _feed(spark, sf, f"{root}/in"):
            src = mon.scored_event_stream(spark, f"{root}/in/*", schema, max_files=max(files, 1))
            mon.start_monitor(spark, src, "event_type", f"{root}/out", f"{root}/ckpt", window=window,
                              slide=slide).awaitTermination()
        _STREAMS[key] = root
    return _STREAMS[key]


def _ts_str(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")) \
             .withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss"))


@register("stream_counters")
def q_stream_counters(spark, sf):
    return finalize(_ts_str(mon.read_sink(spark, f"{_stream_once(spark, sf)}/out", "counters")))


@register("stream_monitor")
def q_stream_monitor(spark, sf):
    return finalize(_ts_str(mon.read_sink(spark, f"{_stream_once(spark, sf)}/out", "metrics")))


# ---- sources and sinks ------------------------------------------------------------
from equilens.sources import tables as tb  # noqa: E402


@register("load_preview")
def q_load_preview(spark, sf):
    li = tb.load_table(spark, path=f"{sf}/lineitem.parquet")
    return tb.preview(li, list(fx.LINEITEM_KEY) + [c for c in li.columns if c not in fx.LINEITEM_KEY])


@register("load_by_name")
def q_load_by_name(spark, sf):
    o = tb.load_table(spark, name="orders", data_dir=sf)
    return finalize(o.agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("o_totalprice").alias("total"),
                          F.count_distinct("o_custkey").cast("long").alias("customers")), scale=2)


def _roundtrip(fmt):
    def q(spark, sf):
        import uuid
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex[:8]}/docs.{fmt}"
        tb.export(fx.docs(spark, sf), path, fmt)
        back = tb.load_table(spark, path=path, json_records_array=False)
        return back.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"),
                           F.col("source").cast("string"), F.col("n_chars").cast("long"),
                           F.col("quality").cast("int"), F.col("toxic").cast("int"))
    return q


for _fmt in ("csv", "json", "parquet"):
    register(f"roundtrip_{_fmt}")(_roundtrip(_fmt))


# ---- intersectional groups, subgroups, calibration, subgroup report -------------------
from equilens.operators import subgroup as sg_ops  # noqa: E402


@register("intersectional_confusion")
def q_intersectional_conf(spark, sf):
    return finalize(sg_ops.intersectional_confusion(fx.scored(spark, sf), P3))


@register("intersectional")
def q_intersectional(spark, sf):
    return finalize(fair_ops.fairness_from_confusion(sg_ops.intersectional_confusion(fx.scored(spark, sf), P3)))


@register("subgroups_top10")
def q_subgroups_top10(spark, sf):
    return finalize(sg_ops.subgroups_top(fx.scored(spark, sf), P3, min_support=100, k=10))


@register("calibration")
def q_calibration(spark, sf):
    return finalize(sg_ops.calibration_by_group(fx.scored(spark, sf), P3))


@register("subgroup_report")
def q_subgroup_report(spark, sf):
    d = audit_split(spark, sf)
    scored = ml_ops.fit_score(d.where("is_train"), d, A, "LR", keep=["is_train", "l_returnflag"])
    return finalize(sg_ops.subgroup_report(scored, {"c_mktsegment": "BUILDING", "l_returnflag": "R"}))


# ---- vector distances (embeddings, per label group) ------------------------------------
from equilens.functions.distances import METRICS as DIST_METRICS  # noqa: E402
from equilens.operators import vectors as vec_ops  # noqa: E402


def _dist_query(metric):
    def q(spark, sf):
        return finalize(vec_ops.distance_to_centroid(fx.vectors(spark, sf), "embedding", "label", "vec_id", metric))
    return q


for _dm in DIST_METRICS:
    register(f"distance_{_dm}")(_dist_query(_dm))


# ---- closed-form classifiers (aggregates + driver p x p algebra) ---------------------
from equilens.operators import discriminant as disc_ops  # noqa: E402


def _disc_query(kind):
    def q(spark, sf):
        d = audit_split(spark, sf)
        return finalize(disc_ops.fit_score(d.where("is_train"), d.where("not is_train"), list(A.numerical),
                                           A.protected, kind, keep=KEYS), scale=4)
    return q


for _k in ("NB", "LDA", "QDA"):
    register(f"score_{_k.lower()}_closed")(_disc_query(_k))


def _disc_pair_query(kind):
    """Two features, so that the oracle can invert the covariance by hand."""
    def q(spark, sf):
        d = audit_split(spark, sf)
        return finalize(disc_ops.fit_score(d.where("is_train"), d.where("not is_train"), ["l_quantity", "l_discount"],
                                           A.protected, kind, keep=KEYS), scale=4)
    return q


for _k in ("LDA", "QDA"):
    register(f"score_{_k.lower()}_two_features")(_disc_pair_query(_k))


@register("run_status")
def q_run_status(spark, sf):
    mh = _scored_history(spark, sf)
    fs = mh.groupBy("run_id").agg(F.max("iteration").alias("total_iterations")).withColumn("max_iterations", F.lit(10)) \
        .withColumn("termination_reason", F.lit("epsilon_threshold"))
    out = run_ops.run_status(mh, fs).drop("run_id")
    for c in ("max_epsilon_series", "accuracy_series"):
        out = out.withColumn(c, F.transform(c, lambda x: F.round(x, 6)))
    return finalize(out)


@register("run_status_loop")
def q_run_status_loop(spark, sf):
    """The same over a real run (rows only)."""
    mh, _, fs = _run_once(spark, sf)
    return run_ops.run_status(mh, fs).drop("run_id")


@register("bin_protected")
def q_bin_protected(spark, sf):
    """Numeric protected columns in quartile bins, others as they are."""
    a = fx.audit(spark, sf).select(*KEYS, "l_quantity", "p_retailprice", "o_orderpriority")
    spec = type(A)(A.target, ("l_quantity", "p_retailprice", "o_orderpriority"))
    return enc_ops.bin_protected(a, spec)


def _nb_scored(spark, sf, where_test=True, keep=()):
    d = audit_split(spark, sf)
    return disc_ops.fit_score(d.where("is_train"), d.where("not is_train") if where_test else d, list(A.numerical),
                              A.protected, "NB", keep=keep)


@register("evaluate_nb")
def q_evaluate_nb(spark, sf):
    """All accuracy and fairness metrics of the closed-form naive Bayes on the test rows."""
    conf = conf_ops.confusion_table(_nb_scored(spark, sf), A.protected)
    acc = fair_ops.accuracy_from_confusion(conf).select("metric", F.lit(None).cast("string").alias("protected"), "value")
    return finalize(acc.unionByName(fair_ops.fairness_from_confusion(conf)))


@register("subgroup_report_nb")
def q_subgroup_report_nb(spark, sf):
    scored = _nb_scored(spark, sf, where_test=False, keep=["is_train", "l_returnflag"])
    return finalize(sg_ops.subgroup_report(scored, {"c_mktsegment": "BUILDING", "l_returnflag": "R"}))


@register("epsilon_order_h")
def q_epsilon_order_h(spark, sf):
    return finalize(eps_ops.epsilon_order_h(fx.audit(spark, sf), A, h=len(A.features) - 2))


# ---- importance (permutation, lasso) and boosting -------------------------------------
@register("permutation_importance")
def q_permutation_importance(spark, sf):
    d = audit_split(spark, sf)
    model = ml_ops.fit(d.where("is_train"), A, "LR")
    test = d.where("not is_train").select(*dict.fromkeys([*KEYS, *A.features, "label_Y"]))
    return finalize(imp_ops.permutation_importance(model, test, list(A.features), KEYS))


@register("score_knn")
def q_score_knn(spark, sf):
    """Five nearest neighbours of every test document by length and quality."""
    from equilens.operators import knn
    d = split_ops.hash_split(fx.docs(spark, sf), ["doc_id"], 0.3, 1)
    return finalize(knn.knn_score(d.where("is_train"), d.where("not is_train"), ["n_chars", "quality"], "toxic", "doc_id",
                                  keep=("doc_id",)))


@register("lasso_importance")
def q_lasso_importance(spark, sf):
    d = audit_split(spark, sf)
    return finalize(imp_ops.lasso_importance(d.where("is_train"), A.numerical, A.categorical))


@register("adaboost_score")
def q_adaboost(spark, sf):
    from equilens.operators import boosting
    d = audit_split(spark, sf)
    model = boosting.fit_adaboost(d.where("is_train"), A)
    return finalize(boosting.score_adaboost(model, d.where("not is_train"), A, keep=KEYS))


@register("distance_mahalanobis")
def q_distance_mahalanobis(spark, sf):
    return finalize(vec_ops.mahalanobis_to_centroid(fx.vectors(spark, sf), "embedding", "label", "vec_id"))


@register("epsilon_docs")
def q_epsilon_docs(spark, sf):
    """20 source groups (190 pairs) and two features: small groups, p = 2."""
    return finalize(eps_ops.epsilon(fx.docs(spark, sf), fx.DOCS_SPEC))


@register("epsilon_nulls")
def q_epsilon_nulls(spark, sf):
    """Nulls inside numeric and categorical features: skipped by the means and value counts."""
    return finalize(eps_ops.epsilon(fx.nulls(spark, sf), A))


@register("epsilon_num_d")
def q_epsilon_num_d(spark, sf):
    """num-d mode (sqeuclidean, z-scored over all n^2 cells), exact from moments; checked against
    the dense matrix on a small table in tests/test_epsilon.py (an n^2 SQL oracle is too heavy)."""
    return finalize(eps_ops.epsilon_num_d(written(fx.audit(spark, sf).select(*A.protected, *A.numerical, *A.categorical), "audit"), A))


D_NUM_D = type(A)("doc_id", ("lang", "source"), ("n_chars",), ("quality", "toxic"))


@register("epsilon_num_d_docs")
def q_epsilon_num_d_docs(spark, sf):
    """num-d (sqeuclidean, z-scored) on the labelled documents, few enough for a dense oracle."""
    return finalize(eps_ops.epsilon_num_d(fx.docs(spark, sf), D_NUM_D))


@register("epsilon_num_d_cityblock")
def q_epsilon_num_d_cityblock(spark, sf):
    """num-d with the city-block distance, scaled by its mean."""
    return finalize(eps_ops.epsilon_num_d(fx.docs(spark, sf), D_NUM_D, EpsilonConfig(scale="mean"), "cityblock"))


@register("epsilon_docs_ks")
def q_epsilon_docs_ks(spark, sf):
    """KS on the docs fixture: 20 source groups become 20 pivot slots (190 pair statistics)."""
    return finalize(eps_ops.epsilon(fx.docs(spark, sf), fx.DOCS_SPEC, EpsilonConfig(num="num-b")))


@register("stream_counters_sliding")
def q_stream_counters_sliding(spark, sf):
    """2-day windows sliding by 1 day: every event is counted in two windows."""
    return finalize(_ts_str(mon.read_sink(spark, f"{_stream_once(spark, sf, '2 days', '1 day')}/out", "counters")))
