"""Durable run state: every finished iteration is one written row, from which a run goes on in a new session.

A row holds what the next step needs (change set, thresholds, skipped attributes, iteration) and
the history of its own iteration.  It names the configuration and a fingerprint of the prepared
base table; a run is only resumed on the same of both.  The base table, its differences and the
beta sequence are rebuilt from them, so the state stays a few kilobytes whatever the table's size.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.functions.beta import beta_stream
from equilens.operators.transform import apply_changes
from equilens.plans import run as runs
from equilens.plans.mitigate import raw_differences
from equilens.spec import AuditSpec

_SCHEMA = ("run_id string, iteration int, written double, fingerprint string, configuration string, spec string, dataset string, "
           "started double, changes string, skipped array<string>, terminated boolean, reason string, epsilon_threshold double, "
           "accuracy_threshold double, history array<struct<metric:string,protected:string,value:double>>, "
           "info struct<ts:double,selected_protected:string,selected_attr:string,changes:string>, "
           "epsilon array<struct<protected:string,attr:string,epsilon:double>>")


def fingerprint(base: DataFrame) -> str:
    """Rows and an order-free hash of the whole table."""
    cells = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(base.columns)])
    r = base.agg(F.count(F.lit(1)).alias("n"), F.sum(cells.cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h'] or 0}"


def _config(cfg) -> str:
    # how far a run may go is no part of what it computes
    return json.dumps({k: v for k, v in asdict(cfg).items() if k != "max_iterations"}, sort_keys=True)


def save(ctx: runs.RunContext, folder: str, mark: str) -> None:
    """Write the state after the current iteration; a repeated write of an iteration replaces it."""
    st, k = ctx.state, ctx.state.iteration
    info = next(i for i in ctx.infos if i[1] == k)
    row = (st.run_id, k, time.time(), mark, _config(ctx.cfg), json.dumps(asdict(ctx.spec), sort_keys=True), json.dumps(ctx.dataset),
           ctx.started, json.dumps(st.changes, sort_keys=True, default=str), list(st.skipped), st.terminated, st.reason,
           st.eps_threshold, st.acc_threshold, [h[2:] for h in ctx.hist if h[1] == k], info[2:], [e[2:] for e in ctx.eps_rows if e[1] == k])
    ctx.spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/run_state/run={st.run_id}/step={k}")


def load(spark: SparkSession, folder: str, run_id: str) -> list:
    """State rows of a run by iteration."""
    path = f"{folder}/run_state/run={run_id}"
    return sorted(spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(path).collect(), key=lambda r: r["iteration"])


def resume(spark: SparkSession, df: DataFrame, spec: AuditSpec, key_cols, cfg: runs.RunConfig, folder: str, run_id: str) -> runs.RunContext:
    """The run as it stood after its last written iteration, ready for the next ``step``.

    Raises where the table, the roles or the configuration differ from those of the run.
    """
    rows = load(spark, folder, run_id)
    if not rows or [r["iteration"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"no complete state of run {run_id!r} in {folder}")
    last = rows[-1]
    if last["configuration"] != _config(cfg) or last["spec"] != json.dumps(asdict(spec), sort_keys=True):
        raise ValueError("the run was made with another configuration")
    base = runs.prepare(df, spec, key_cols, cfg)
    if fingerprint(base) != last["fingerprint"]:
        base.unpersist()
        raise ValueError("the table is not the one that the run was made on")
    changes, stream = json.loads(last["changes"]), beta_stream(cfg.stream, spark=spark)
    reason = last["reason"]
    over = last["terminated"] and not (reason == "max_iterations" and last["iteration"] < cfg.max_iterations)
    state = runs.RunState(run_id, changes, last["iteration"], last["epsilon_threshold"], last["accuracy_threshold"],
                          tuple(last["skipped"]), over, reason if over else None)
    s = raw_differences(apply_changes(base, spec, changes, stream, cfg.method, cfg.multi), spec, cfg.eps)
    history = [(run_id, r["iteration"], *h) for r in rows for h in r["history"]]
    metrics = {(h["metric"], h["protected"]): h["value"] for h in last["history"] if h["metric"] not in ("mean_epsilon", "max_epsilon")}
    return runs.RunContext(spark, base, spec, cfg, stream, list(key_cols), state, metrics, history,
                           [(run_id, r["iteration"], *r["info"]) for r in rows],
                           [(run_id, r["iteration"], *e) for r in rows for e in r["epsilon"]], s, json.loads(last["dataset"]), last["started"])


def run_durable(spark: SparkSession, df: DataFrame, spec: AuditSpec, key_cols, cfg: runs.RunConfig, folder: str,
                run_id: str | None = None, steps: int | None = None) -> runs.RunContext:
    """Run, or go on with ``run_id``, writing the state after each iteration; stops after ``steps`` iterations if given."""
    if run_id is None:
        ctx = runs.init_run(spark, df, spec, key_cols, cfg)
        mark = fingerprint(ctx.base)
        save(ctx, folder, mark)
    else:
        ctx = resume(spark, df, spec, key_cols, cfg, folder, run_id)
        mark = load(spark, folder, run_id)[-1]["fingerprint"]
    while not ctx.state.terminated and steps != 0:
        before = ctx.state.iteration
        runs.step(ctx)
        if ctx.state.iteration > before:
            save(ctx, folder, mark)
        steps = None if steps is None else steps - 1
    return ctx
