"""The perceptron fitted by passes over blocks: the library's own where its blocks weigh all rows alike."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from equilens.operators import cells as cl
from equilens.operators import models, perceptron
from equilens.spec import AuditSpec

SPEC = AuditSpec("y", ("o",), ("x", "z"), ("c", "k"))


def _rows(spark, n=512):
    rnd = random.Random(4)
    rows = []
    for i in range(n + 150):
        c, k, x, z = rnd.choice("abcde"), rnd.randint(1, 4), rnd.gauss(0, 2), rnd.random()
        rows.append((i, c, k, x, z, "o", int(x + "abcde".index(c) - k + rnd.gauss(0, 1) > 0)))
    df = spark.createDataFrame(rows, "id int, c string, k int, x double, z double, o string, label_Y int")
    # the library averages blocks of 128 rows of a partition, so full blocks weigh every row alike
    return df.where(F.col("id") < n).coalesce(1), df.where(F.col("id") >= n)


@pytest.mark.parametrize("steps", [1, 25])
def test_steps_are_the_librarys(spark, monkeypatch, steps):
    monkeypatch.setattr(perceptron, "CHUNK_ROWS", 100)
    monkeypatch.setattr(cl, "BLOCK_ROWS", 150)
    train, test = _rows(spark)

    def few(name, **kw):
        return models.classifier(name, **kw).setMaxIter(steps)
    lib = models.score(Pipeline(stages=[*models.feature_stages(SPEC), few("MLP", n_features=9)]).fit(train), test, SPEC, keep=("id",))
    ours = perceptron.score_mlp(perceptron.fit_mlp(train.repartition(3), SPEC, few), test, SPEC, keep=("id",))
    j = ours.join(lib.select("id", F.col("pred_Y").alias("p"), F.col("score_S").alias("s")), "id")
    r = j.agg(F.count("*").alias("n"), F.max(F.abs(F.col("s") - F.col("score_S"))).alias("off"), F.sum((F.col("p") != F.col("pred_Y")).cast("int")).alias("bad")).first()
    assert r["n"] == test.count() and r["off"] < 1e-6 and r["bad"] == 0


def test_scores_by_name(spark):
    train, test = _rows(spark)
    odd = spark.createDataFrame([(9001, None, 1, 0.5, 0.5, None, 1), (9002, "new", None, None, 0.1, "o", None)], test.schema)
    got = {r["id"]: r for r in models.fit_score(train, test.unionByName(odd), SPEC, "MLP", keep=("id",)).collect()}
    assert len(got) == 152 and sum(r["pred_Y"] == r["label_Y"] for r in got.values()) > 110
    with pytest.raises(Exception, match="to learn from is"):
        models.fit_score(train.unionByName(odd), test, SPEC, "MLP")
    only = AuditSpec("y", ("o",), ("x", "z"), ())
    assert models.fit_score(train, test, only, "MLP").count() == 150


@pytest.mark.parametrize("runs", [0, 16])
@pytest.mark.parametrize("scale", [1e-3, 1.0, 50.0])
def test_sums_are_loss_and_gradient(monkeypatch, runs, scale):
    """Whatever share of the hidden units is 0 or 1; exponentials are taken only of those that are not, for a chunk."""
    import numpy as np
    monkeypatch.setattr(perceptron, "MAX_RUNS", runs)
    monkeypatch.setattr(perceptron, "CHUNK_ROWS", 64)
    rng, hidden = np.random.default_rng(1), 30
    cells = cl.Cells(["x", "z"], [np.zeros(0)] * 2, {"c": list("abcde"), "k": list("12")})
    design = perceptron.Design(cells)
    codes = np.stack([np.full(700, cells.starts[j]) + (rng.integers(0, cells.sizes[j], 700) if j > 1 else 0) for j in range(4)]).astype(cells.dtype)
    v, y = np.stack([rng.normal(size=700), 900 * rng.random(700)]), rng.integers(0, 2, 700).astype(np.int8)
    blocks = list(design.sorted(iter([(0, codes[:, :300], y[:300], v[:, :300]), (1, codes[:, 300:], y[300:], v[:, 300:])])))
    w = rng.normal(size=(design.inputs + 1) * hidden + 2 * hidden + 2) * scale
    widths, real = [], perceptron._sigmoid_of_minus
    monkeypatch.setattr(perceptron, "_sigmoid_of_minus", lambda z: widths.append(z.shape[1]) or real(z))
    (got,) = perceptron._sums(design, w, hidden)(blocks)
    assert min(widths) < hidden / 2 or scale < 1

    first, bias = w[:design.inputs * hidden].reshape(-1, hidden), w[design.inputs * hidden:][:hidden]
    second, out = w[(design.inputs + 1) * hidden:-2].reshape(hidden, 2), w[-2:]
    x = np.zeros((700, design.inputs))
    x[:, :2] = v.T
    for j, (a, b) in design.slots.items():
        code = codes[j].astype(int) - cells.starts[j]
        x[np.flatnonzero(code < b - a), a + code[code < b - a]] = 1
    h = 1 / (1 + np.exp(-np.clip(x @ first + bias, -600, 600)))
    raw = h @ second + out
    p = np.exp(raw - raw.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    e = p - np.eye(2)[y]
    back = (e @ second.T) * h * (1 - h)
    want = np.concatenate([[700, -np.log(p[np.arange(700), y]).sum()], (x.T @ back).ravel(), back.sum(axis=0), (h.T @ e).ravel(), e.sum(axis=0)])
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9 * np.abs(want).max())
