"""Gaussian naive Bayes, LDA and QDA from aggregates: fit = one grouped aggregate
(class counts, sums, cross-products), the p x p algebra on the driver (p = number of
features, bounded), score = a Column expression.  No row leaves the executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VAR_SMOOTHING = 1e-9


def _moments(train: DataFrame, feats, label: str, cross: bool):
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(feats)]
    aggs += [F.sum(F.col(f).cast("double") * F.col(f).cast("double")).alias(f"q{i}") for i, f in enumerate(feats)]
    if cross:
        aggs += [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"x{i}_{j}")
                 for i, a in enumerate(feats) for j, b in enumerate(feats) if i < j]
    rows = train.groupBy(F.col(label).cast("int").alias("y")).agg(*aggs).collect()
    return {r["y"]: r for r in rows}


def _sigmoid_diff(d1: Column, d0: Column) -> Column:
    """P(y=1) = exp(d1) / (exp(d0) + exp(d1)), computed stably."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(d0 - d1))


def fit_gaussian_nb(train: DataFrame, feats, label: str = "label_Y") -> dict:
    """Class priors, per-class means and (population) variances plus var_smoothing x max variance."""
    m = _moments(train, feats, label, cross=False)
    n_all = sum(r["n"] for r in m.values())
    tot = train.agg(*[F.var_pop(F.col(f).cast("double")).alias(f"v{i}") for i, f in enumerate(feats)]).first()
    eps = VAR_SMOOTHING * max(tot[f"v{i}"] or 0.0 for i in range(len(feats)))
    model = {"feats": list(feats), "classes": {}}
    for y, r in m.items():
        mu = [r[f"s{i}"] / r["n"] for i in range(len(feats))]
        var = [r[f"q{i}"] / r["n"] - mu[i] ** 2 + eps for i in range(len(feats))]
        model["classes"][y] = {"prior": r["n"] / n_all, "mu": mu, "var": var}
    return model


def score_gaussian_nb(df: DataFrame, model: dict) -> tuple[Column, Column]:
    def jll(c):
        k = model["classes"][c]
        out = F.lit(math.log(k["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in k["var"]))
        for f, mu, v in zip(model["feats"], k["mu"], k["var"]):
            out = out - F.pow(F.col(f).cast("double") - F.lit(mu), 2) / F.lit(2 * v)
        return out
    d0, d1 = jll(0), jll(1)
    return _sigmoid_diff(d1, d0), F.when(d1 > d0, 1).otherwise(0)


def _cov(r, feats, mu):
    p = len(feats)
    c = np.zeros((p, p))
    for i in range(p):
        for j in range(p):
            if i == j:
                s = r[f"q{i}"]
            else:
                s = r[f"x{min(i, j)}_{max(i, j)}"]
            c[i, j] = s - r["n"] * mu[i] * mu[j]
    return c   # scatter matrix


def fit_lda(train: DataFrame, feats, label: str = "label_Y") -> dict:
    """Pooled within-class covariance scatter / (n - K); linear discriminant per class."""
    m = _moments(train, feats, label, cross=True)
    n_all = sum(r["n"] for r in m.values())
    mus = {y: np.array([r[f"s{i}"] / r["n"] for i in range(len(feats))]) for y, r in m.items()}
    scatter = sum(_cov(r, feats, mus[y]) for y, r in m.items())
    cov = scatter / (n_all - len(m))
    inv = np.linalg.pinv(cov)
    cls = {}
    for y, r in m.items():
        w = inv @ mus[y]
        cls[y] = {"w": w.tolist(), "b": float(-0.5 * mus[y] @ inv @ mus[y] + math.log(r["n"] / n_all))}
    return {"feats": list(feats), "classes": cls}


def score_lda(df: DataFrame, model: dict) -> tuple[Column, Column]:
    def lin(c):
        k = model["classes"][c]
        out = F.lit(k["b"])
        for f, w in zip(model["feats"], k["w"]):
            out = out + F.lit(float(w)) * F.col(f).cast("double")
        return out
    d0, d1 = lin(0), lin(1)
    return _sigmoid_diff(d1, d0), F.when(d1 > d0, 1).otherwise(0)


def fit_qda(train: DataFrame, feats, label: str = "label_Y", reg_param: float = 0.01) -> dict:
    """Per-class covariance (ddof 1) shrunk towards the identity: (1 - r) S + r I."""
    m = _moments(train, feats, label, cross=True)
    n_all = sum(r["n"] for r in m.values())
    p = len(feats)
    cls = {}
    for y, r in m.items():
        mu = np.array([r[f"s{i}"] / r["n"] for i in range(p)])
        s = _cov(r, feats, mu) / (r["n"] - 1)
        s = (1 - reg_param) * s + reg_param * np.eye(p)
        sign, logdet = np.linalg.slogdet(s)
        cls[y] = {"mu": mu.tolist(), "inv": np.linalg.inv(s).tolist(), "logdet": float(logdet),
                  "prior": r["n"] / n_all}
    return {"feats": list(feats), "classes": cls}


def score_qda(df: DataFrame, model: dict) -> tuple[Column, Column]:
    feats = model["feats"]

    def quad(c):
        k = model["classes"][c]
        z = [F.col(f).cast("double") - F.lit(mu) for f, mu in zip(feats, k["mu"])]
        q = F.lit(0.0)
        for i in range(len(feats)):
            for j in range(len(feats)):
                q = q + F.lit(float(k["inv"][i][j])) * z[i] * z[j]
        return F.lit(math.log(k["prior"]) - 0.5 * k["logdet"]) - 0.5 * q
    d0, d1 = quad(0), quad(1)
    return _sigmoid_diff(d1, d0), F.when(d1 > d0, 1).otherwise(0)


FITTERS = {"NB": (fit_gaussian_nb, score_gaussian_nb), "LDA": (fit_lda, score_lda), "QDA": (fit_qda, score_qda)}


def fit_score(train: DataFrame, test: DataFrame, feats, protected, kind: str, label: str = "label_Y",
              keep=()) -> DataFrame:
    fit, score = FITTERS[kind]
    model = fit(train, feats, label)
    s, p = score(test, model)
    return test.select(*keep, F.col(label).cast("int").alias("label_Y"), p.alias("pred_Y"), s.alias("score_S"),
                       *protected)
