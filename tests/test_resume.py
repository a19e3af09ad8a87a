"""A run that goes on from its written state equals one that was never interrupted."""

import dataclasses
import json

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from equilens.plans import run as run_ops
from equilens.plans import state
from equilens.sources import fixtures as fx

A, KEYS = fx.AUDIT_SPEC, list(fx.LINEITEM_KEY)


def _history(ctx):
    return {(i, m, p): v for _, i, m, p, v in ctx.hist}


def test_resumed_run_equals_whole_run(spark, tmp_path):
    cfg = run_ops.RunConfig()
    assert cfg.max_iterations == 2
    df = fx.audit(spark, SF_SMALL)
    whole = run_ops.init_run(spark, df, A, KEYS, cfg)
    while not whole.state.terminated:
        run_ops.step(whole)
    first = state.run_durable(spark, df, A, KEYS, cfg, str(tmp_path), steps=1)
    run_id = first.state.run_id
    run_ops.finish(first)
    assert first.state.iteration == 1 and not first.state.terminated
    other = spark.newSession()                        # nothing of the first run's objects is used again
    rest = state.run_durable(other, fx.audit(other, SF_SMALL), A, KEYS, cfg, str(tmp_path), run_id=run_id)
    assert rest.state.run_id == run_id
    assert (rest.state.iteration, rest.state.reason, rest.state.changes) == (whole.state.iteration, whole.state.reason, whole.state.changes)
    assert rest.state.eps_threshold == pytest.approx(whole.state.eps_threshold)
    got, want = _history(rest), _history(whole)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert [i[1:2] + i[3:] for i in rest.infos] == [i[1:2] + i[3:] for i in whole.infos]
    assert [r["iteration"] for r in state.load(other, str(tmp_path), run_id)] == list(range(whole.state.iteration + 1))

    # another table, other roles, another configuration or an unknown run are refused
    with pytest.raises(ValueError, match="not the one"):
        state.resume(spark, df.where(F.col("l_orderkey") > 3), A, KEYS, cfg, str(tmp_path), run_id)
    with pytest.raises(ValueError, match="configuration"):
        state.resume(spark, df, A, KEYS, dataclasses.replace(cfg, method="log"), str(tmp_path), run_id)
    with pytest.raises(Exception):
        state.resume(spark, df, A, KEYS, cfg, str(tmp_path), "nobody")
    whole.base.unpersist()
    rest.base.unpersist()


def test_state_row_is_small_and_plain(spark, tmp_path):
    row = dict(run_id="r", iteration=0)
    st = run_ops.RunState("r", {"a": {"beta_O": 1}, "b": "dropped", "c": {"x": "y"}}, 0, 0.5, 0.9, ("d",))
    ctx = run_ops.RunContext(spark, None, A, run_ops.RunConfig(), [], KEYS, st, {}, [("r", 0, "ACC", None, 0.5), ("r", 0, "SP", "g", None)],
                             [("r", 0, 1.0, None, None, "{}")], [("r", 0, "g", "a", 0.25)], None, {"rows": 3}, 1.0)
    for _ in range(2):                                # writing an iteration twice replaces it
        state.save(ctx, str(tmp_path), "3:1")
    (got,) = state.load(spark, str(tmp_path), "r")
    assert {k: got[k] for k in row} == row and json.loads(got["changes"]) == st.changes and got["skipped"] == ["d"]
    assert [tuple(h) for h in got["history"]] == [("ACC", None, 0.5), ("SP", "g", None)] and got["fingerprint"] == "3:1"
