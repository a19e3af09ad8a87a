"""Apply a change set to a table, and check candidate changes for validity.

A change set maps attribute -> {'beta_O': i, 'beta_Y': j} (numeric),
{old: new, ...} (categorical re-bin) or 'dropped' (constant 1).  It is always
compiled against the *base* table into one ``select``, so iterating never
stacks projections and the plan stays the same size in every iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.transforms import numeric_change, rebin
from equilens.spec import AuditSpec


def arcsin_stats(df: DataFrame, cols) -> dict:
    row = df.agg(*[F.max(F.abs(F.col(c))).alias(f"M{i}") for i, c in enumerate(cols)],
                 *[F.min(F.abs(F.col(c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: {"amax": float(row[f"M{i}"]), "amin": float(row[f"m{i}"])} for i, c in enumerate(cols)}


def change_expr(df: DataFrame, spec: AuditSpec, attr: str, change, stream, method="poly", multi="t1",
                stats=None):
    x = F.col(attr)
    if change == "dropped":
        return F.lit(1)
    if attr in spec.numerical:
        return numeric_change(x.cast("double"), change, stream, method, multi,
                              stats=(stats or {}).get(attr))
    if attr in spec.categorical:
        return rebin(x, change, df.schema[attr].dataType)
    return x


def apply_changes(df: DataFrame, spec: AuditSpec, changes: dict, stream, method="poly", multi="t1") -> DataFrame:
    """One projection over the base table with every changed attribute rewritten."""
    stats = None
    if method == "arcsin":
        num = [a for a, c in changes.items() if a in spec.numerical and c != "dropped"]
        stats = arcsin_stats(df, num) if num else {}
    cols = []
    for c in df.columns:
        if c in changes:
            cols.append(change_expr(df, spec, c, changes[c], stream, method, multi, stats).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def validity(df: DataFrame, spec: AuditSpec, candidates: list, stream, method="poly", multi="t1") -> DataFrame:
    """``(candidate, attr, valid)`` for many (attr, change) candidates in ONE aggregate pass.

    numeric: valid when no value becomes +-inf or NaN (from a finite input);
    categorical: valid when more than one distinct value remains after re-binning.
    An index outside the stream makes the candidate invalid.
    """
    aggs, meta = [], []
    stats = arcsin_stats(df, [a for a, _ in candidates if a in spec.numerical]) if method == "arcsin" else None
    for i, (attr, change) in enumerate(candidates):
        try:
            e = change_expr(df, spec, attr, change, stream, method, multi, stats)
        except (ValueError, KeyError, IndexError):
            meta.append((i, attr, None))
            continue
        if attr in spec.numerical and change != "dropped":
            bad = F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
            aggs.append(F.max(F.when(F.col(attr).isNotNull() & bad, 1).otherwise(0)).alias(f"v{i}"))
            meta.append((i, attr, "num"))
        else:
            aggs.append(F.count_distinct(e).alias(f"v{i}"))
            meta.append((i, attr, "cat"))
    row = df.agg(*aggs).first() if aggs else {}
    out = []
    for i, attr, kind in meta:
        if kind is None:
            ok = False
        elif kind == "num":
            ok = row[f"v{i}"] == 0
        else:
            ok = row[f"v{i}"] != 1
        out.append((i, attr, bool(ok)))
    return df.sparkSession.createDataFrame(out, "candidate int, attr string, valid boolean")
