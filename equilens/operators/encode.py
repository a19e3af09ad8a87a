"""Column kinds, binning of numeric protected attributes, label encoding, target binarisation.

Scalars that steer the plan (distinct counts, quantile edges, min/max) are
computed by distributed aggregates and brought to the driver as a handful of
numbers; the row-level work is a projection with literal edges or a join with
a dictionary whose size decides between broadcast and shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.operators.prefix import quantile_values, running_sums, slice_of, text_slice_of
from equilens.operators.profile import distinct_values, equal_width_bin, equal_width_edges
from equilens.operators.sizing import broadcast_if_small, written
from equilens.spec import (LOADER_CATEGORICAL_MAX_DISTINCT, LOADER_OBJECT_DISTINCT_RATIO,
                           PROFILE_CATEGORICAL_MAX_DISTINCT, AuditSpec)

DICT_BROADCAST_ROWS = 200_000   # labels of a column up to which its dictionary is broadcast


def infer_kinds(df: DataFrame, cols=None, rule: str = "loader") -> DataFrame:
    """``(attr, kind)`` with kind in categorical | numerical | none.

    loader rule: all-null -> none; timestamp/date -> numerical; boolean ->
    categorical; numeric with < 20 distinct -> categorical else numerical;
    string fully castable to number with distinct/rows < 0.1 -> categorical,
    else numerical; other strings -> categorical.
    profile rule: numeric with <= 10 distinct -> categorical, else numerical;
    everything else categorical.
    """
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    strings = [c for c in cols if isinstance(types[c], T.StringType)]
    info = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"nn{i}") for i, c in enumerate(cols)],
                  *[F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(f"cn{i}") for i, c in enumerate(cols) if c in strings]).first()
    distinct = {r["attr"]: r["unique_values"] for r in distinct_values(df, cols).collect()}
    rows = []
    for i, c in enumerate(cols):
        t, nn, d = types[c], info[f"nn{i}"], distinct.get(c, 0)
        if rule == "profile":
            kind = ("numerical" if isinstance(t, T.NumericType) and d > PROFILE_CATEGORICAL_MAX_DISTINCT
                    else "categorical")
        elif nn == 0:
            kind = "none"
        elif isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            kind = "numerical"
        elif isinstance(t, T.BooleanType):
            kind = "categorical"
        elif isinstance(t, T.NumericType):
            kind = "categorical" if d < LOADER_CATEGORICAL_MAX_DISTINCT else "numerical"
        elif c in strings and info[f"cn{i}"] == nn:
            kind = "categorical" if d / info["rows"] < LOADER_OBJECT_DISTINCT_RATIO else "numerical"
        else:
            kind = "categorical"
        rows.append((c, kind, int(d)))
    return df.sparkSession.createDataFrame(rows, "attr string, kind string, unique_values long")


def resolve_spec(df: DataFrame, target: str, protected, categorical=None, numerical=None) -> AuditSpec:
    """Validated roles: user kind lists win, unknown columns dropped, Y and O removed from X."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not in the table")
    protected = [protected] if isinstance(protected, str) else list(protected or [])
    if not protected:
        raise ValueError("no protected attribute given")
    valid = [p for p in protected if p in df.columns]
    if not valid:
        raise ValueError(f"protected attributes {protected} do not exist in the table")
    kinds = None
    if categorical is None or numerical is None:
        kinds = {r["attr"]: r["kind"] for r in infer_kinds(df).collect()}
    cat = [c for c in (categorical if categorical is not None else
                       [a for a, k in kinds.items() if k == "categorical"]) if c in df.columns]
    num = [c for c in (numerical if numerical is not None else
                       [a for a, k in kinds.items() if k == "numerical"]) if c in df.columns]
    excl = {target, *valid}
    return AuditSpec(target, tuple(valid), tuple(c for c in num if c not in excl),
                     tuple(c for c in cat if c not in excl))


# ---- binning of numeric protected attributes ---------------------------------
def bin_median(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """'True' when value > median else 'False' (null -> 'False'); median exact, interpolated."""
    m = quantile_values(df, col, [0.5])[0]
    flag = F.coalesce(F.col(col).cast("double") > F.lit(m), F.lit(False)) if m is not None else F.lit(False)
    return df.withColumn(out or col, F.when(flag, "True").otherwise("False"))


def quartile_edges(df: DataFrame, col: str, q: int = 4):
    return quantile_values(df, col, [i / q for i in range(q + 1)])


def bin_equal_width(df: DataFrame, col: str, k: int = 4, out: str | None = None) -> DataFrame:
    """Equal-width bins, right-closed, lowest included; null -> 'nan'; constant -> one bin."""
    mm = df.agg(F.min(F.col(col).cast("double")).alias("lo"), F.max(F.col(col).cast("double")).alias("hi")).first()
    x = F.col(col).cast("double")
    if mm["lo"] is None:
        b = F.lit(None).cast("int")
    elif mm["hi"] > mm["lo"]:
        b = equal_width_bin(x, equal_width_edges(mm["lo"], mm["hi"], k))
    else:
        b = F.lit(0)
    return df.withColumn(out or col, F.when(x.isNull(), "nan").otherwise(b.cast("string")))


def bin_quartile(df: DataFrame, col: str, q: int = 4, fallback_bins: int = 4,
                 out: str | None = None) -> DataFrame:
    """Quantile bins (right-closed, lowest included); duplicate edges fall back to equal width."""
    edges = quartile_edges(df, col, q)
    if any(e is None for e in edges) or len(set(edges)) < len(edges):
        return bin_equal_width(df, col, fallback_bins, out)
    x = F.col(col).cast("double")
    return df.withColumn(out or col, F.when(x.isNull(), "nan").otherwise(equal_width_bin(x, edges).cast("string")))


def bin_protected(df: DataFrame, spec: AuditSpec, method: str = "quartile") -> DataFrame:
    """Bin every numeric protected column (even 0/1 codes, as the method does)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in spec.protected:
        if isinstance(types[c], T.NumericType):
            df = bin_median(df, c) if method == "median" else bin_quartile(df, c)
    return df


# ---- label encoding -------------------------------------------------------------
def encoding_dictionary(df: DataFrame, cols, null_label: str = "NaN") -> DataFrame:
    """``(attr, code, label)``: sorted distinct labels -> 0..K-1.

    Strings sort by code point with nulls rendered as 'NaN' among them (a null and a string
    'NaN' are one label); numerics sort numerically with null as the last code.  Codes come
    from sliced running counts, so no task orders all values of an attribute.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in cols:
        num = isinstance(types[c], T.NumericType)
        label = F.coalesce(F.col(c).cast("string"), F.lit(null_label))
        x = F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) if num else F.lit(0.0)
        parts.append(F.struct(F.lit(c).alias("attr"), label.alias("label"), F.lit(num).alias("num"), x.alias("x")))
    d = (df.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
           .groupBy("attr", "label").agg(F.max("num").alias("num"), F.min("x").alias("x"), F.lit(1).alias("one")))

    def slices(rows: DataFrame, n: int):
        by_number = slice_of(rows.where("num"), F.col("x"), n)
        return F.when(F.col("num"), by_number).otherwise(text_slice_of(rows.where("NOT num"), F.col("label"), n))

    ranked = running_sums(d, ["attr"], ["x", "label"], ["one"], slicer=slices)
    return ranked.select("attr", (F.col("cum_one") - 1).cast("int").alias("code"), "label")


def label_encode(df: DataFrame, cols, dictionary: DataFrame | None = None) -> DataFrame:
    """Replace each column by its integer code (dictionary from ``encoding_dictionary``).

    Each column is one join with its labels: broadcast up to ``DICT_BROADCAST_ROWS`` labels,
    a shuffle join beyond.
    """
    cols = list(cols)
    d = dictionary if dictionary is not None else encoding_dictionary(df, cols)
    d = written(d.select("attr", "code", "label"), "dictionary")
    out = df
    for c in cols:
        dc = d.where(F.col("attr") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        out = (out.join(broadcast_if_small(dc, DICT_BROADCAST_ROWS),
                        F.coalesce(F.col(c).cast("string"), F.lit("NaN")) == F.col("_label"), "left")
                  .select(*[F.col("_code").cast("int").alias(c) if x == c else F.col(x) for x in out.columns]))
    return out


def inverse_encode(df: DataFrame, col: str, dictionary: DataFrame, out: str | None = None) -> DataFrame:
    """Codes back to labels; an unknown column raises."""
    if col not in df.columns:
        raise ValueError(f"column {col!r} not in the table")
    dc = dictionary.where(F.col("attr") == col).select(F.col("code").alias("_c"), F.col("label").alias("_l"))
    return (df.join(broadcast_if_small(dc, DICT_BROADCAST_ROWS), F.col(col) == F.col("_c"), "left")
              .withColumn(out or col, F.col("_l")).drop("_c", "_l"))


# ---- target ---------------------------------------------------------------------
def binarize_target(df: DataFrame, target: str, out: str = "label_Y") -> DataFrame:
    """Target to 0/1: null fill (strings 'NaN', numerics median), then
    two values -> 0/1 by sort order (kept when already 0/1); numeric with more
    values -> value > median; string with more values -> error; one value -> kept.
    """
    t = {f.name: f.dataType for f in df.schema.fields}[target]
    numeric = isinstance(t, T.NumericType)
    y = F.col(target)
    raw = y.cast("double") if numeric else F.coalesce(y.cast("string"), F.lit("NaN"))
    # nulls, extremes and whether a third value exists: one aggregate, and one filtered row where it
    # may not.  A sketch of two values has two filled registers at most, so it can't estimate 10
    st = df.select(raw.alias("_y")).agg(F.count(F.lit(1)).alias("n"), F.count("_y").alias("nn"), F.min("_y").alias("lo"),
                                        F.max("_y").alias("hi"), F.approx_count_distinct("_y").alias("about")).first()
    lo, hi = st["lo"], st["hi"]
    more = lo is not None and lo != hi and (st["about"] >= 10 or not df.select(raw.alias("_y")).where(
        (F.col("_y") != F.lit(lo)) & (F.col("_y") != F.lit(hi))).isEmpty())
    if numeric and lo is not None and (more or st["nn"] < st["n"]):
        # nulls take the median, which they do not move; it may itself be a third value
        med = quantile_values(df, target, [0.5])[0]
        y = F.coalesce(raw, F.lit(med))
        more = more or (st["nn"] < st["n"] and med not in (lo, hi))
        if more:
            return df.withColumn(out, (y > F.lit(med)).cast("int"))
    else:
        y = raw
    if more:
        n = df.select(raw.alias("_y")).agg(F.count_distinct("_y").alias("d")).first()["d"]
        raise ValueError(f"target {target!r} is multi-class with {n} classes")
    if lo != hi:
        if numeric and lo == 0 and hi == 1:
            return df.withColumn(out, y.cast("int"))
        return df.withColumn(out, F.when(y == F.lit(hi), 1).otherwise(0))
    return df.withColumn(out, y.cast("int") if numeric else F.lit(0))
