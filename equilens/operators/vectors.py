"""Distances of vectors to their group centroid (per protected group), for every metric.

Centroids are one aggregate over (group, position) after posexplode, so the
shuffle carries G x dim rows; rows are then joined to their group's centroid
(a G-row table, AQE broadcasts it) and the distance is an array expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.distances import distance


def centroids(df: DataFrame, vec: str, group: str) -> DataFrame:
    e = df.select(group, F.posexplode(vec).alias("pos", "x"))
    per = e.groupBy(group, "pos").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    return per.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "v"))), lambda s: s["m"]).alias("centroid"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m", "v"))), lambda s: s["v"]).alias("variance"))


def global_variance(df: DataFrame, vec: str) -> DataFrame:
    """Per-position sample variance over all rows (the standardised-euclidean weights)."""
    per = df.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.var_samp("x").alias("v"))
    return per.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("gvar"))


def distance_to_centroid(df: DataFrame, vec: str, group: str, key: str, metric: str) -> DataFrame:
    c = centroids(df, vec, group)
    j = df.select(key, group, vec).join(c, group)
    var = None
    if metric == "seuclidean":
        gv = global_variance(df, vec).first()["gvar"]        # one value per dimension (bounded)
        var = F.array(*[F.lit(float(v)) for v in gv])
    d = distance(metric, F.col(vec), F.col("centroid"), p=2.0, var=var)
    return j.select(key, group, F.lit(metric).alias("metric"), d.alias("dist"))


def inverse_covariance(df: DataFrame, vec: str):
    """Inverse (pseudo-inverse) of the sample covariance of the vectors, inverted on the driver.

    Every position of a vector is one row with the products of its value and all others, so
    the aggregate has one group and one sum for each dimension (dim x dim numbers).
    """
    import numpy as np
    dim = df.select(F.max(F.size(vec))).first()[0] or 0
    n = df.where(F.col(vec).isNotNull()).count()
    at = df.select(F.posexplode(vec).alias("i", "x"), F.col(vec).alias("v"))
    rows = at.groupBy("i").agg(F.sum("x").alias("s"), F.array(*[F.sum(F.col("x") * F.get("v", F.lit(j))) for j in range(dim)])
                               .alias("p")).collect()
    mu, prod = np.zeros(dim), np.zeros((dim, dim))
    for r in rows:
        mu[r["i"]], prod[r["i"]] = r["s"] / n, r["p"]
    return np.linalg.pinv((prod - n * np.outer(mu, mu)) / (n - 1))


def mahalanobis_to_centroid(df: DataFrame, vec: str, group: str, key: str) -> DataFrame:
    """sqrt((x - c)^T VI (x - c)) with VI the inverse covariance over all rows."""
    vi = inverse_covariance(df, vec)
    c = centroids(df, vec, group)
    j = df.select(key, group, vec).join(c, group)
    d = F.zip_with(F.col(vec), F.col("centroid"), lambda a, b: a - b)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in vi])
    y = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, d, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t))
    q = F.aggregate(F.zip_with(y, d, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return j.select(key, group, F.lit("mahalanobis").alias("metric"), F.sqrt(F.greatest(q, F.lit(0.0))).alias("dist"))
