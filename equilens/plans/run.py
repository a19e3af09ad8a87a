"""The debiasing run: thresholds, the iteration loop, history tables and sinks.

State carried between iterations is the change set (a small dict), a few scalars and the
difference table of the current data (one row for each group pair and feature); every
iteration rebuilds the transformed table from the *base* table (persisted once), so plans
never grow with the iteration count.  The history is a small table (one row per iteration and
metric), written per run id; a run that fails writes its record too.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equilens.functions.beta import beta_stream
from equilens.operators import confusion, epsilon as E, fairness, newton
from equilens.operators.encode import bin_protected, binarize_target
from equilens.operators.importance import lasso_importance, mutual_information, permutation_importance, pick_lowest
from equilens.operators.models import fit, fit_score
from equilens.operators.rebin import ae_rebin_r1, ae_rebin_r2
from equilens.operators.sizing import written
from equilens.operators.split import hash_split
from equilens.operators.transform import apply_changes, validity
from equilens.plans.mitigate import mitigation_step, next_index, raw_differences
from equilens.spec import (ACCURACY_THRESHOLD_GAIN, DEFAULT_MAX_ITERATIONS, EPSILON_THRESHOLD_FACTOR, AuditSpec,
                           EpsilonConfig)


@dataclass(frozen=True)
class RunConfig:
    max_iterations: int = DEFAULT_MAX_ITERATIONS
    use_bias_mitigation: bool = True
    use_accuracy_enhancement: bool = False
    classifier: str = "LR"
    epsilon_factor: float = EPSILON_THRESHOLD_FACTOR
    accuracy_gain: float = ACCURACY_THRESHOLD_GAIN
    stream: str = "d4A"
    method: str = "poly"
    multi: str = "t1"
    importance: str = "a1"        # a1 mutual information | a2 lasso | a3 permutation
    ae_rebin: str = "r1"          # r1 class counts | r2 rarest | r3 best refit
    bin_method: str = "quartile"  # quartile | median | none: numeric protected columns
    split_seed: int = 1
    eps: EpsilonConfig = field(default_factory=EpsilonConfig)


@dataclass
class RunState:
    run_id: str
    changes: dict
    iteration: int
    eps_threshold: float
    acc_threshold: float
    skipped: tuple = ()
    terminated: bool = False
    reason: str | None = None


def evaluate(table: DataFrame, spec: AuditSpec, cfg: RunConfig) -> dict:
    """Fit on the train rows, score the test rows, return {(metric, protected): value}."""
    scored = fit_score(table.where("is_train"), table.where("not is_train"), spec, cfg.classifier)
    conf = confusion.confusion_table(scored, spec.protected)
    acc = fairness.accuracy_from_confusion(conf).select("metric", F.lit(None).cast("string").alias("protected"),
                                                        "value")
    rows = acc.unionByName(fairness.fairness_from_confusion(conf)).collect()
    return {(r["metric"], r["protected"]): r["value"] for r in rows}


def overall(metrics: dict) -> float:
    """Overall fairness of collected metrics: 1 minus the mean of the pairwise values, not below 0."""
    vals = [v for (_, p), v in metrics.items() if p is not None and v is not None]
    return max(0.0, 1.0 - (sum(vals) / len(vals) if vals else 0.0))


def _eps_summary(s: DataFrame, spec: AuditSpec, cfg: RunConfig, changes: dict):
    """Epsilon rows, their mean and the largest usable one, from the raw difference table."""
    eps = E.epsilon_from_s(E.scale_s(s, cfg.eps.scale), cfg.eps.sum)
    rows = sorted((r["protected"], r["attr"], r["epsilon"]) for r in eps.collect())
    known = [e for _, _, e in rows if e is not None]
    n_origin = len({p for p, _, _ in rows})
    mean = sum(known) / (len(rows) + n_origin) if rows else 0.0
    dropped = {a for a, c in changes.items() if c == "dropped"}
    usable = [r for r in rows if r[2] is not None and r[1] not in dropped]
    best = min(usable, key=lambda r: (-r[2], r[0], r[1])) if usable else (None, None, 0.0)
    return rows, mean, best


def prepare(df: DataFrame, spec: AuditSpec, key_cols, cfg: RunConfig) -> DataFrame:
    """The base table: numeric protected columns binned, target as 0/1, train rows marked; only the
    columns the run needs, written once before and after (every step reads them).  (Categories stay as they are: the operators compare labels.)"""
    need = dict.fromkeys([*key_cols, *spec.protected, *spec.features, spec.target])
    out = written(df.select(*need), "rows")
    if cfg.bin_method != "none":
        out = bin_protected(out, spec, cfg.bin_method)
    return written(hash_split(binarize_target(out, spec.target, "label_Y"), key_cols, 0.3, cfg.split_seed), "base")


def _record(run_id, iteration, metrics, mean_eps, max_pick, changes, selected=None):
    out = [(run_id, iteration, m, p, float(v) if v is not None else None) for (m, p), v in metrics.items()]
    out.append((run_id, iteration, "mean_epsilon", None, float(mean_eps or 0.0)))
    out.append((run_id, iteration, "max_epsilon", max_pick[0], float(max_pick[2] or 0.0)))
    at = selected if selected and selected[1] else max_pick
    return out, (run_id, iteration, time.time(), at[0], at[1], json.dumps(changes, sort_keys=True, default=str))


def _importance(train: DataFrame, spec: AuditSpec, cfg: RunConfig, key_cols) -> DataFrame:
    if cfg.importance == "a1":
        return mutual_information(train, "label_Y", spec.numerical, spec.categorical)
    if cfg.importance == "a2":
        return lasso_importance(train, spec.numerical, spec.categorical)
    if cfg.importance == "a3":
        return permutation_importance(fit(train, spec, cfg.classifier), train, list(spec.features), key_cols)
    raise ValueError(f"unknown importance measure: {cfg.importance}")


def accuracy_step(base: DataFrame, spec: AuditSpec, cfg: RunConfig, changes: dict, skipped: tuple,
                  stream: list, key_cols):
    """One accuracy-enhancement attempt on the least important usable feature.

    Everything is measured on the *train* rows, split once more: a change is kept if a refit on
    the inner train rows scores better on the inner test rows than the current table does.
    """
    inner = hash_split(base.where("is_train").drop("is_train"), key_cols, 0.3, f"{cfg.split_seed}:inner")
    cur = apply_changes(inner, spec, changes, stream, cfg.method, cfg.multi)
    excl = [a for a, c in changes.items() if c == "dropped"] + list(skipped)
    pick = pick_lowest(_importance(cur, spec, cfg, key_cols), excl).first()
    if pick is None:
        return changes, skipped, None
    attr = pick["attr"]
    prev = changes[attr] if isinstance(changes.get(attr), dict) else None
    if attr in spec.categorical:
        if cfg.ae_rebin == "r3":
            merge, _ = ae_rebin_r3(inner, spec, attr, changes, stream, cfg)
        elif cfg.ae_rebin in ("r1", "r2"):
            ch = (ae_rebin_r1(cur, "label_Y", [attr]) if cfg.ae_rebin == "r1" else ae_rebin_r2(cur, [attr])).first()
            merge = {ch["from_value"]: ch["to_value"]} if ch is not None else None
        else:
            raise ValueError(f"unknown re-bin choice: {cfg.ae_rebin}")
        if merge is None:
            return changes, skipped + (attr,), attr
        change = {**(prev or {}), **merge}
    else:
        change = {**(prev or {}), "beta_Y": next_index(prev, "beta_Y")}
    if not validity(base, spec, [(attr, change)], stream, cfg.method, cfg.multi).first()["valid"]:
        return changes, skipped + (attr,), attr
    trial = {**changes, attr: change}
    before = evaluate(cur, spec, cfg)[("ACC", None)]
    after = evaluate(apply_changes(inner, spec, trial, stream, cfg.method, cfg.multi), spec, cfg)[("ACC", None)]
    if after > before:
        return trial, skipped, attr
    return changes, skipped + (attr,), attr


@dataclass
class RunContext:
    """Everything one run carries between steps: the persisted base table, the difference table of
    the current data, the config, the small driver state and the history rows."""
    spark: SparkSession
    base: DataFrame
    spec: AuditSpec
    cfg: RunConfig
    stream: list
    key_cols: list
    state: RunState
    metrics: dict
    hist: list
    infos: list
    eps_rows: list
    s: DataFrame
    dataset: dict
    started: float
    error: str | None = None


def init_run(spark: SparkSession, df: DataFrame, spec: AuditSpec, key_cols, cfg: RunConfig = RunConfig(),
             dataset_name: str = "table") -> RunContext:
    """Iteration 0: thresholds from the initial epsilon and accuracy."""
    started, run_id = time.time(), uuid.uuid4().hex[:12]
    stream = beta_stream(cfg.stream, spark=spark)
    base = prepare(df, spec, key_cols, cfg)
    s = raw_differences(base, spec, cfg.eps)
    eps, mean0, max0 = _eps_summary(s, spec, cfg, {})
    metrics0 = evaluate(base, spec, cfg)
    st = RunState(run_id, {}, 0, (mean0 or 0.0) * cfg.epsilon_factor,
                  metrics0[("ACC", None)] * (1 + cfg.accuracy_gain))
    h, i = _record(run_id, 0, metrics0, mean0, max0, {})
    if not cfg.use_bias_mitigation and not cfg.use_accuracy_enhancement:
        st.terminated, st.reason = True, "disabled"
    shape = {"name": dataset_name, "rows": base.count(), "columns": len(df.columns)}
    return RunContext(spark, base, spec, cfg, stream, list(key_cols), st, metrics0, list(h), [i],
                      [(run_id, 0, *r) for r in eps], s, shape, started)


def step(ctx: RunContext) -> RunContext:
    """One iteration: mitigation, optional enhancement, transform, evaluate, epsilon, record.

    A threshold ends the run only where its side is in use: epsilon with bias mitigation,
    accuracy with accuracy enhancement.
    """
    st, cfg, spec, base = ctx.state, ctx.cfg, ctx.spec, ctx.base
    if st.terminated:
        return ctx
    if st.iteration >= cfg.max_iterations:
        st.terminated, st.reason = True, "max_iterations"
        return ctx
    st.iteration += 1
    selected, found = None, True
    if cfg.use_bias_mitigation:
        r = mitigation_step(base, spec, st.changes, ctx.stream, cfg.eps, cfg.method, cfg.multi, ctx.s)
        st.changes, selected, found = r.changes, (r.protected, r.attr), r.attr is not None
    if cfg.use_accuracy_enhancement:
        st.changes, st.skipped, tried = accuracy_step(base, spec, cfg, st.changes, st.skipped, ctx.stream, ctx.key_cols)
        found = found or tried is not None
    cur = apply_changes(base, spec, st.changes, ctx.stream, cfg.method, cfg.multi)
    ctx.metrics = evaluate(cur, spec, cfg)
    ctx.s.unpersist()
    ctx.s = raw_differences(cur, spec, cfg.eps)
    eps, mean_e, max_e = _eps_summary(ctx.s, spec, cfg, st.changes)
    h, i = _record(st.run_id, st.iteration, ctx.metrics, mean_e, max_e, st.changes, selected)
    ctx.hist += h
    ctx.infos.append(i)
    ctx.eps_rows += [(st.run_id, st.iteration, *r) for r in eps]
    if cfg.use_bias_mitigation and max_e[2] is not None and max_e[2] <= st.eps_threshold:
        st.terminated, st.reason = True, "epsilon_threshold"
    elif cfg.use_accuracy_enhancement and ctx.metrics[("ACC", None)] >= st.acc_threshold:
        st.terminated, st.reason = True, "accuracy_threshold"
    elif not found:
        st.terminated, st.reason = True, "no_candidate"
    elif st.iteration >= cfg.max_iterations:
        st.terminated, st.reason = True, "max_iterations"
    return ctx


def run_log(ctx: RunContext) -> dict[str, DataFrame]:
    """The experiment log as tables: info (one row: run, dataset, configuration, thresholds, duration,
    state, error), metrics, iterations, epsilon, and the final metrics with the overall fairness."""
    spark, st, cfg = ctx.spark, ctx.state, ctx.cfg
    run_id = st.run_id
    final = [(run_id, m, p, float(v) if v is not None else None) for (m, p), v in ctx.metrics.items()]
    final.append((run_id, "Overall_Fairness", None, overall(ctx.metrics)))
    info = (run_id, ctx.started, ctx.dataset["name"], int(ctx.dataset["rows"]), int(ctx.dataset["columns"]),
            ctx.spec.target, list(ctx.spec.protected), time.time() - ctx.started,
            json.dumps(asdict(cfg), sort_keys=True), st.eps_threshold, st.acc_threshold,
            "failed" if ctx.error else "completed", st.reason, st.iteration,
            json.dumps(st.changes, sort_keys=True, default=str), ctx.error)
    return {
        "info": spark.createDataFrame([info], "run_id string, started double, dataset string, rows long, columns int, "
                                              "target string, protected array<string>, duration_seconds double, "
                                              "configuration string, epsilon_threshold double, accuracy_threshold double, "
                                              "state string, termination_reason string, total_iterations int, "
                                              "changes string, error string"),
        "metrics": spark.createDataFrame(ctx.hist, "run_id string, iteration int, metric string, protected string, value double"),
        "iterations": spark.createDataFrame(ctx.infos, "run_id string, iteration int, ts double, selected_protected string, "
                                                       "selected_attr string, changes string"),
        "epsilon": spark.createDataFrame(ctx.eps_rows, "run_id string, iteration int, protected string, attr string, epsilon double"),
        "final": spark.createDataFrame(final, "run_id string, metric string, protected string, value double"),
    }


def finish(ctx: RunContext, out_dir: str | None = None):
    """History tables of the run: (metrics_history, iterations, final_state); the log is written to ``out_dir``."""
    spark, st = ctx.spark, ctx.state
    log = run_log(ctx)
    fs = spark.createDataFrame([(st.run_id, st.iteration, ctx.cfg.max_iterations, st.reason or "max_iterations",
                                 json.dumps(st.changes, sort_keys=True, default=str),
                                 st.eps_threshold, st.acc_threshold)],
                               "run_id string, total_iterations int, max_iterations int, termination_reason string, "
                               "changes string, epsilon_threshold double, accuracy_threshold double")
    if out_dir:
        write_run(log["metrics"], log["iterations"], fs, out_dir, log)
    ctx.s.unpersist()
    ctx.base.unpersist()
    return log["metrics"], log["iterations"], fs


def run(spark: SparkSession, df: DataFrame, spec: AuditSpec, key_cols, cfg: RunConfig = RunConfig(),
        out_dir: str | None = None, dataset_name: str = "table"):
    """Run the loop to termination; returns (metrics_history, iterations, final_state) DataFrames.

    A failing step still writes the log of what was reached, with the error, and raises.
    """
    ctx = init_run(spark, df, spec, key_cols, cfg, dataset_name)
    try:
        while not ctx.state.terminated:
            step(ctx)
    except Exception as e:
        ctx.error = f"{type(e).__name__}: {e}"
        finish(ctx, out_dir)
        raise
    return finish(ctx, out_dir)


def run_status(metrics_history: DataFrame, final: DataFrame) -> DataFrame:
    """Progress, termination reason and the max-epsilon / accuracy series of each run
    (series length = number of iterations, small by construction)."""
    series = (metrics_history.where(F.col("metric").isin("max_epsilon", "ACC"))
              .groupBy("run_id").agg(
                  F.transform(F.array_sort(F.collect_list(F.when(F.col("metric") == "max_epsilon",
                                                                 F.struct("iteration", "value")))),
                              lambda x: x["value"]).alias("max_epsilon_series"),
                  F.transform(F.array_sort(F.collect_list(F.when(F.col("metric") == "ACC",
                                                                 F.struct("iteration", "value")))),
                              lambda x: x["value"]).alias("accuracy_series")))
    return final.join(series, "run_id").select(
        "run_id", "total_iterations", "termination_reason",
        F.least(F.lit(100.0), F.col("total_iterations") * 100.0 / F.greatest(F.col("max_iterations"), F.lit(1)))
        .alias("progress_percent"), "max_epsilon_series", "accuracy_series")


def write_run(metrics_history: DataFrame, iterations: DataFrame, final: DataFrame, out_dir: str, log: dict | None = None):
    """Experiment log: append the run's tables (parquet, partitioned by run id) and a JSON export."""
    metrics_history.write.mode("append").partitionBy("run_id").parquet(f"{out_dir}/run_metrics")
    iterations.write.mode("append").partitionBy("run_id").parquet(f"{out_dir}/run_iterations")
    final.write.mode("append").partitionBy("run_id").parquet(f"{out_dir}/run_final")
    for name in ("info", "epsilon", "final"):
        if log:
            log[name].write.mode("append").partitionBy("run_id").parquet(f"{out_dir}/run_log_{name}")
    nested = (metrics_history.groupBy("run_id", "iteration")
              .agg(F.map_from_entries(F.collect_list(F.struct(
                  F.concat_ws(":", "metric", F.coalesce("protected", F.lit(""))), "value"))).alias("metrics"))
              .join(iterations, ["run_id", "iteration"]))
    nested.write.mode("append").partitionBy("run_id").json(f"{out_dir}/run_json")


# ---- views over the history -----------------------------------------------------
def metric_series(metrics_history: DataFrame) -> DataFrame:
    """Value per iteration and metric, averaged over protected attributes."""
    return metrics_history.groupBy("run_id", "iteration", "metric").agg(F.avg("value").alias("value"))


def before_after(metrics_history: DataFrame) -> DataFrame:
    """Change from the previous iteration and from iteration 0, per metric and protected attribute."""
    k = ["run_id", "metric", "protected"]
    w = Window.partitionBy(*k).orderBy("iteration")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (metrics_history.select(*k, "iteration", "value")
            .withColumn("initial", F.first("value").over(whole))
            .withColumn("delta_previous", F.col("value") - F.lag("value").over(w))
            .withColumn("delta_initial", F.col("value") - F.col("initial")))


def rows_changed(base: DataFrame, spec: AuditSpec, changes: dict, stream: list, method: str = "poly",
                 multi: str = "t1") -> DataFrame:
    """``(attr, rows_changed)``: rows whose value differs from the base, in one aggregate.

    The change set compiles to expressions over the base columns, so the
    comparison needs no join and no row identity."""
    from equilens.operators.transform import arcsin_stats, change_expr
    attrs = [a for a in changes if a in base.columns]
    if not attrs:
        return base.sparkSession.createDataFrame([], "attr string, rows_changed long")
    stats = arcsin_stats(base, [a for a in attrs if a in spec.numerical]) if method == "arcsin" else None
    aggs = []
    for a in attrs:
        e = change_expr(base, spec, a, changes[a], stream, method, multi, stats)
        same = e.cast("string").eqNullSafe(F.col(a).cast("string"))
        aggs.append(F.sum(F.when(same, 0).otherwise(1)).cast("long").alias(a))
    return base.agg(*aggs).unpivot([], attrs, "attr", "rows_changed")


def ae_rebin_r3(base: DataFrame, spec: AuditSpec, attr: str, changes: dict, stream: list, cfg: RunConfig):
    """r3: the merge {i: j} of two values of ``attr`` whose refit on the train rows of ``base`` is the most
    accurate on its other rows, ties to the first pair by value; ``(None, 0.0)`` where there is no pair.

    Logistic regression fits all merges side by side, a pass over the rows for each Newton step; other
    classifiers have no sums to share, so each merge is a fit of its own there.
    """
    trials = rebin_trials(base, spec, attr, changes, stream, cfg)
    best = max(trials, key=lambda t: t[2] or 0.0, default=None)
    if best is None or not best[2]:
        return None, 0.0
    typed = base.sparkSession.range(1).select(*[F.lit(v).cast(base.schema[attr].dataType) for v in best[:2]]).first()
    return {typed[0]: typed[1]}, best[2]


def rebin_trials(base: DataFrame, spec: AuditSpec, attr: str, changes: dict, stream: list, cfg: RunConfig) -> list:
    """``(from, to, accuracy)`` of every pair of current values of ``attr``, as text."""
    earlier = changes.get(attr) if isinstance(changes.get(attr), dict) else {}
    others = {a: c for a, c in changes.items() if a != attr}
    table = apply_changes(base, spec, others, stream, cfg.method, cfg.multi)
    if cfg.classifier in ("LR", "LR1000"):
        return newton.merge_accuracies(table.where("is_train"), table.where("not is_train"), spec.numerical, spec.categorical,
                                       attr, "label_Y", earlier)
    now = newton.levels_of(apply_changes(base, spec, {attr: earlier}, stream, cfg.method, cfg.multi), [attr])[attr]
    score = lambda merges: evaluate(apply_changes(base, spec, {**others, attr: merges}, stream, cfg.method, cfg.multi), spec, cfg)
    return [(a, b, score({**earlier, a: b})[("ACC", None)]) for k, a in enumerate(now) for b in now[k + 1:]]
