"""Vector distances as array expressions (``aggregate(zip_with(...))``), JVM side.

Operands are ``array<double>`` columns of equal length.  Boolean metrics
take the ``x > 0`` form of both operands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def _zip(a, b, f) -> Column:
    return F.zip_with(a, b, f)


def _dot(a, b):
    return _sum(_zip(a, b, lambda x, y: x * y))


def _norm(a):
    return F.sqrt(_dot(a, a))


def _centre(a):
    m = _sum(a) / F.size(a)
    return F.transform(a, lambda x: x - m)


def _bool_counts(a, b):
    def c(f):
        return F.size(F.filter(_zip(a, b, lambda x, y: f(x > 0, y > 0)), lambda t: t)).cast("double")
    return (c(lambda x, y: x & y), c(lambda x, y: x & ~y), c(lambda x, y: ~x & y), c(lambda x, y: ~x & ~y))


def distance(metric: str, a: Column, b: Column, p: float = 2.0, var: Column | None = None) -> Column:
    n = F.size(a).cast("double")
    if metric == "sqeuclidean":
        return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "euclidean":
        return F.sqrt(distance("sqeuclidean", a, b))
    if metric == "cityblock":
        return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))
    if metric == "chebyshev":
        return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))
    if metric == "minkowski":
        return F.pow(_sum(_zip(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))
    if metric == "cosine":
        return 1 - _dot(a, b) / (_norm(a) * _norm(b))
    if metric == "correlation":
        return distance("cosine", _centre(a), _centre(b))
    if metric == "canberra":
        return _sum(_zip(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0,
                                                    F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)))
    if metric == "braycurtis":
        return _sum(_zip(a, b, lambda x, y: F.abs(x - y))) / _sum(_zip(a, b, lambda x, y: F.abs(x + y)))
    if metric == "hamming":
        return F.size(F.filter(_zip(a, b, lambda x, y: x != y), lambda t: t)) / n
    if metric == "seuclidean":
        sq = _zip(_zip(a, b, lambda x, y: (x - y) * (x - y)), var, lambda d, v: d / v)
        return F.sqrt(_sum(sq))
    if metric == "jensenshannon":
        # probability vectors from magnitudes: |x| / sum |x|
        sa, sb = _sum(F.transform(a, F.abs)), _sum(F.transform(b, F.abs))
        pa = F.transform(a, lambda x: F.abs(x) / sa)
        pb = F.transform(b, lambda x: F.abs(x) / sb)
        m = _zip(pa, pb, lambda x, y: (x + y) / 2)
        kl = lambda p_, q_: _sum(_zip(p_, q_, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)))
        return F.sqrt((kl(pa, m) + kl(pb, m)) / 2)
    tt, tf, ft, ff = _bool_counts(a, b)
    ne = tf + ft
    if metric == "jaccard":
        return F.when(tt + ne > 0, ne / (tt + ne)).otherwise(0.0)
    if metric == "dice":
        return ne / (2 * tt + ne)
    if metric == "yule":
        return F.when(tf * ft > 0, 2 * tf * ft / (tt * ff + tf * ft)).otherwise(0.0)
    if metric == "kulczynski1":
        return tt / ne
    if metric == "matching":
        return ne / n
    if metric == "rogerstanimoto":
        return 2 * ne / (tt + ff + 2 * ne)
    if metric == "russellrao":
        return (n - tt) / n
    if metric == "sokalmichener":
        return 2 * ne / (tt + ff + 2 * ne)
    if metric == "sokalsneath":
        return 2 * ne / (tt + 2 * ne)
    raise ValueError(f"unsupported metric: {metric}")


METRICS = ["euclidean", "sqeuclidean", "cityblock", "chebyshev", "minkowski", "cosine", "correlation",
           "canberra", "braycurtis", "hamming", "seuclidean", "jensenshannon", "jaccard", "dice", "yule",
           "kulczynski1", "matching", "rogerstanimoto", "russellrao", "sokalmichener", "sokalsneath"]
