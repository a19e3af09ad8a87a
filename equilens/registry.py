"""Named queries over the fixture views, one per operator (see README).

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
double columns are rounded to 6 decimals so that results compare stably
with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finalize(df: DataFrame, scale: int = 6, scales: dict | None = None) -> DataFrame:
    """Round every double column to ``scale`` decimals (per-column ``scales`` override)."""
    out = []
    scales = scales or {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            s = scales.get(f.name, scale)
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), s).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def all_queries() -> dict[str, Callable]:
    # import modules that register queries
    from equilens import queries_core  # noqa: F401
    return dict(QUERIES)
