"""Exact quantiles by counting refinement against numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from equilens.operators import prefix

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _check(spark, columns):
    rows = list(zip(*columns))
    names = [f"c{i}" for i in range(len(columns))]
    got = prefix.quantile_table(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)), names, QS)
    for c, values in zip(names, columns):
        some = np.array(sorted(v for v in values if v is not None), float)
        if not len(some):
            assert got[c] == [None] * len(QS)
            continue
        for q, g in zip(QS, got[c]):
            h = (len(some) - 1) * q
            lo, hi = some[math.floor(h)], some[math.ceil(h)]
            want = lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)
            assert g == want or math.isnan(g) and math.isnan(want), (c, q)


def test_quantiles_of_odd_columns(spark):
    """Skewed, constant, tied, null, tiny, huge, signed-zero and infinite columns in one table."""
    r = np.random.default_rng(0)
    n = 3000
    inf = float("inf")
    _check(spark, [
        r.normal(0, 1, n).tolist(), np.exp(r.normal(0, 30, n)).tolist(), [7.0] * n, r.integers(0, 4, n).astype(float).tolist(),
        [None] * n, [None if i % 3 else float(i) for i in range(n)], [5e-324 * (i % 3) for i in range(n)],
        [(-1.0) ** i * 1.7e308 * (i / n) for i in range(n)], [0.0 if i % 2 else -0.0 for i in range(n)],
        [inf if i % 5 == 0 else -inf if i % 5 == 1 else float(i) for i in range(n)]])


def test_one_huge_value_does_not_hide_the_rest(spark):
    """All other values share the first pass's lowest bin; later passes open it."""
    _check(spark, [[1e300] + [float(i) / 7 for i in range(2000)]])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=False)), min_size=1, max_size=40))
def test_quantiles_of_any_floats(spark, values):
    with np.errstate(all="ignore"):
        if any(v is not None and abs(v) > 1e307 for v in values):
            values = [v if v is None or math.isinf(v) else v / 16 for v in values]
        if not any(v is not None and math.isinf(v) for v in values):
            _check(spark, [values])


def test_no_value_is_ordered_or_shuffled(spark, monkeypatch):
    """A pass exchanges counters of bins; the values themselves never meet an exchange or a sort."""
    plans = []
    refine = prefix._refine
    monkeypatch.setattr(prefix, "_refine", lambda df, cols, ranges, bins: plans.append(len(ranges)) or refine(df, cols, ranges, bins))
    df = spark.range(20000).selectExpr("double(hash(id)) AS v")
    want = np.quantile(np.array([r.v for r in df.collect()]), 0.5)
    assert prefix.quantile_values(df, "v", [0.5]) == [pytest.approx(want, abs=0)]
    assert len(plans) <= 3
