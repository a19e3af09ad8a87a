"""Column profile and data-level (model-free) bias.

Plan shape: one wide aggregate for the per-column statistics (count, non-null,
min/max/mean/std) and one ``explode -> groupBy(attr, value)`` aggregate for exact
distinct counts and value counts, with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.functions.columns import safe_div
from equilens.spec import PROFILE_CATEGORICAL_MAX_DISTINCT, TOP_VALUE_COUNTS


def is_numeric(dt) -> bool:
    return isinstance(dt, T.NumericType)


def column_stats(df: DataFrame, cols=None) -> DataFrame:
    """One row per column: rows, non_null, min, max, mean, std (numerics)."""
    cols = list(cols or df.columns)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs.append(F.count(x).alias(f"nn_{i}"))
        if is_numeric(types[c]):
            d = x.cast("double")
            aggs += [F.min(d).alias(f"mn_{i}"), F.max(d).alias(f"mx_{i}"),
                     F.avg(d).alias(f"av_{i}"), F.stddev_samp(d).alias(f"sd_{i}")]
    wide = df.agg(*aggs)
    null = F.lit(None).cast("double")
    rows = [F.struct(F.lit(c).alias("attr"), F.lit(i).alias("pos"),
                     F.lit(is_numeric(types[c])).alias("numeric"),
                     F.col(f"nn_{i}").alias("non_null"),
                     *[(F.col(f"{p}_{i}") if is_numeric(types[c]) else null).alias(n)
                       for p, n in (("mn", "min"), ("mx", "max"), ("av", "mean"), ("sd", "std"))])
            for i, c in enumerate(cols)]
    return wide.select(F.col("_rows").alias("rows"), F.explode(F.array(*rows)).alias("s")).select("rows", "s.*")


def value_counts(df: DataFrame, cols) -> DataFrame:
    """``(attr, value, cnt)`` for the given columns; value rendered as string, nulls kept."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "attr string, value string, cnt long")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    return (df.select(pairs.alias("p")).select("p.*")
              .groupBy("attr", "value").agg(F.count(F.lit(1)).cast("long").alias("cnt")))


def distinct_values(df: DataFrame, cols) -> DataFrame:
    """``(attr, unique_values)``: exact non-null distinct counts of all columns.

    One aggregate over (attr, value) with map-side combine; numbers stay numbers.  A column
    without values has no row.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    null = F.lit(None)
    items = F.explode(F.array(*[F.struct(
        F.lit(c).alias("attr"), (F.col(c).cast("double") if is_numeric(types[c]) else null.cast("double")).alias("x"),
        (null.cast("string") if is_numeric(types[c]) else F.col(c).cast("string")).alias("s")) for c in cols]))
    pairs = df.select(items.alias("i")).select("i.*").where(F.col("x").isNotNull() | F.col("s").isNotNull())
    return pairs.groupBy("attr", "x", "s").agg(F.lit(1).alias("one")) \
        .groupBy("attr").agg(F.count(F.lit(1)).cast("long").alias("unique_values"))


def column_profile(df: DataFrame, cols=None) -> DataFrame:
    """unique_values, missing_count, missing_percentage, kind and continuous stats per column.

    kind follows the profile rule: numeric with <= 10 distinct values is
    categorical, other numerics continuous, non-numerics categorical.
    """
    cols = list(cols or df.columns)
    # both sides have one row for each column
    prof = column_stats(df, cols).join(distinct_values(df, cols), "attr", "left")
    uv = F.coalesce(F.col("unique_values"), F.lit(0)).cast("long")
    kind = F.when(F.col("numeric") & (uv > PROFILE_CATEGORICAL_MAX_DISTINCT), "continuous").otherwise("categorical")
    cont = kind == "continuous"
    return prof.select(
        "attr", kind.alias("kind"), uv.alias("unique_values"),
        (F.col("rows") - F.col("non_null")).cast("long").alias("missing_count"),
        safe_div((F.col("rows") - F.col("non_null")) * 100.0, F.col("rows")).alias("missing_percentage"),
        *[F.when(cont, F.col(c)).alias(c) for c in ("min", "max", "mean", "std")])


def top_value_counts(df: DataFrame, cols, k: int = TOP_VALUE_COUNTS) -> DataFrame:
    """Top-k value counts per column (count desc, ties by value); nulls excluded."""
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    w = Window.partitionBy("attr").orderBy(F.desc("cnt"), F.asc("value"))
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    return (df.groupBy(F.col(target).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).cast("long").alias("cnt")))


def equal_width_edges(lo: float, hi: float, k: int):
    """Edges as ``numpy.linspace`` builds them: start + i * step, last edge exact."""
    step = (hi - lo) / k
    edges = [lo + i * step for i in range(k)] + [hi]
    return edges


def equal_width_bin(x, edges) -> "F.Column":
    """Right-closed bin index of ``x`` for the given edges: #inner edges strictly below x."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    return F.size(F.filter(inner, lambda e: e < x)).cast("int")


def histogram(df: DataFrame, cols, k: int = 10) -> DataFrame:
    """Equal-width histogram per numeric column; bins right-closed, first includes min.

    Edges need one scalar pass (min/max); counting is one aggregate over
    (attr, bin) after an in-stage explode, so only attrs x k rows shuffle.
    """
    cols = list(cols)
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{i}") for i, c in enumerate(cols)],
                *[F.max(F.col(c).cast("double")).alias(f"mx_{i}") for i, c in enumerate(cols)]).first()
    parts, meta = [], []
    for i, c in enumerate(cols):
        lo, hi = mm[f"mn_{i}"], mm[f"mx_{i}"]
        if lo is None:
            continue
        edges = equal_width_edges(lo, hi, k) if hi > lo else [lo, hi]
        x = F.col(c).cast("double")
        parts.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("attr"), equal_width_bin(x, edges).alias("bin"))))
        meta += [(c, b, float(edges[b]), float(edges[b + 1])) for b in range(len(edges) - 1)]
    if not parts:
        return df.sparkSession.createDataFrame([], "attr string, bin int, lo double, hi double, cnt long")
    counts = (df.select(F.explode(F.array(*parts)).alias("p")).where(F.col("p").isNotNull())
                .select("p.*").groupBy("attr", "bin").agg(F.count(F.lit(1)).cast("long").alias("cnt")))
    bins = df.sparkSession.createDataFrame(meta, "attr string, bin int, lo double, hi double")
    return (F.broadcast(bins).join(counts, ["attr", "bin"], "left")
            .select("attr", "bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")))


# ---- data-level bias -------------------------------------------------------
def group_positive_rates(df: DataFrame, target: str, protected) -> DataFrame:
    """Share of rows whose target equals 1, per non-null group of each protected column."""
    protected = list(protected)
    agg = (df.groupingSets([[p] for p in protected], *protected)
             .agg(F.count(F.lit(1)).cast("long").alias("n"),
                  F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).cast("long").alias("n_pos"),
                  *[F.grouping(p).alias(f"_g{i}") for i, p in enumerate(protected)]))
    which, grp = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, p in enumerate(protected):
        which = F.when(F.col(f"_g{i}") == 0, F.lit(p)).otherwise(which)
        grp = F.when(F.col(f"_g{i}") == 0, F.col(p).cast("string")).otherwise(grp)
    return (agg.select(which.alias("protected"), grp.alias("group_value"), "n", "n_pos")
               .where(F.col("group_value").isNotNull())
               .withColumn("positive_rate", F.col("n_pos") / F.col("n")))


def data_bias(rates: DataFrame) -> DataFrame:
    """Statistical parity difference, disparate impact and the two fixed proxies per attribute."""
    g = rates.groupBy("protected").agg(F.max("positive_rate").alias("hi"), F.min("positive_rate").alias("lo"),
                                       F.count(F.lit(1)).cast("long").alias("n_groups"))
    spd = F.col("hi") - F.col("lo")
    return g.where(F.col("n_groups") >= 2).select(
        "protected", "n_groups", spd.alias("statistical_parity"),
        F.when(F.col("hi") > 0, F.col("lo") / F.col("hi")).otherwise(F.lit(1.0)).alias("disparate_impact"),
        (spd * 0.8).alias("equal_opportunity_proxy"), (spd * 0.9).alias("equalized_odds_proxy"))


def data_bias_combined(bias: DataFrame) -> DataFrame:
    """Worst case over protected attributes: max of the differences, min of disparate impact."""
    return bias.agg(F.max("statistical_parity").alias("statistical_parity"),
                    F.max("equal_opportunity_proxy").alias("equal_opportunity_proxy"),
                    F.max("equalized_odds_proxy").alias("equalized_odds_proxy"),
                    F.min("disparate_impact").alias("disparate_impact"),
                    F.count(F.lit(1)).cast("long").alias("n_protected"),
                    F.sort_array(F.collect_list(F.struct("protected", "statistical_parity",
                                                         "disparate_impact"))).alias("individual"))


def dataset_summary(df: DataFrame, target: str, features) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_samples"),
                  F.lit(len(list(features))).cast("long").alias("n_features"),
                  F.avg(F.when(F.col(target) == 1, 1.0).otherwise(0.0)).alias("positive_rate"))
