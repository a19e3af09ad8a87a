"""Re-bin choices for categorical attributes (bias mitigation and accuracy enhancement).

All choices are computed from the contingency table (attr, value, group or
class, count); no data pass is needed beyond the aggregate that builds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.operators.epsilon import groups
from equilens.operators.pairs import PAIR, Slots, group_slots, pair_aggregate, wide_counts, with_totals


def bm_rebin_candidates(df: DataFrame, protected, attrs) -> DataFrame:
    """Per (protected, attr, g1 < g2): delta_v = share_g2(v) - share_g1(v) (0 when v is absent
    from either group); merge the value with the largest delta into the one with the smallest.
    ``diff`` = max delta + min delta."""
    slots = group_slots(groups(df, protected))
    return bm_candidates_from_counts(wide_counts(df, slots, attrs, False), slots)


def bm_candidates_from_counts(wide: DataFrame, slots: Slots) -> DataFrame:
    def pair(one: str, two: str) -> dict:
        n1, n2 = F.col(one), F.col(two)
        d = F.when((n1 > 0) & (n2 > 0), n2 / F.col(f"n_{two}") - n1 / F.col(f"n_{one}")).otherwise(F.lit(0.0))
        at = F.when((n1 > 0) | (n2 > 0), F.struct(d.alias("d"), F.col("v").alias("v")))
        return {"hi": F.max(at), "lo": F.min(at)}

    out = pair_aggregate(with_totals(wide, slots), slots, pair).where("hi IS NOT NULL")
    return out.select(*PAIR, "attr", F.col("hi.v").alias("from_value"), F.col("lo.v").alias("to_value"),
                      (F.col("hi.d") + F.col("lo.d")).alias("diff"))


def bm_rebin_choice(cands: DataFrame) -> DataFrame:
    """The pair with the largest |diff| per (protected, attr); ties by (g1, g2)."""
    best = cands.groupBy("protected", "attr").agg(F.min(F.struct(
        (-F.abs(F.col("diff"))).alias("k"), "g1", "g2", "from_value", "to_value", "diff")).alias("b"))
    return best.select("protected", "attr", "b.g1", "b.g2", "b.from_value", "b.to_value", "b.diff")


def class_counts(df: DataFrame, label: str, attrs) -> DataFrame:
    """``(attr, v, y, cnt)`` contingency of categorical attrs against the class."""
    items = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("v")) for a in attrs]))
    return (df.select(F.col(label).alias("y"), items.alias("i")).select("y", "i.*").where(F.col("v").isNotNull())
              .groupBy("attr", "v", "y").agg(F.count(F.lit(1)).cast("long").alias("cnt")))


def ae_rebin_r1(df: DataFrame, label: str, attrs) -> DataFrame:
    """Per attr: delta_v = |count_{y=1}(v) - count_{y=0}(v)| (0 when v is missing from a class);
    merge the value with the largest delta into the one with the smallest (ties by value)."""
    cc = class_counts(df, label, attrs)
    p = cc.groupBy("attr", "v").agg(F.sum(F.when(F.col("y") == 0, F.col("cnt"))).alias("c0"),
                                    F.sum(F.when(F.col("y") == 1, F.col("cnt"))).alias("c1"))
    d = F.when(F.col("c0").isNotNull() & F.col("c1").isNotNull(), F.abs(F.col("c1") - F.col("c0"))).otherwise(F.lit(0))
    g = p.select("attr", "v", d.cast("long").alias("d"))
    agg = g.groupBy("attr").agg(F.max(F.struct(F.col("d"), F.col("v"))).alias("hi"),
                                F.min(F.struct(F.col("d"), F.col("v"))).alias("lo"))
    return agg.select("attr", F.col("hi.v").alias("from_value"), F.col("lo.v").alias("to_value"),
                      (F.col("hi.d") + F.col("lo.d")).alias("diff"))


def ae_rebin_r2(df: DataFrame, attrs) -> DataFrame:
    """Per attr: merge the second rarest value into the rarest (ties by value)."""
    items = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("v")) for a in attrs]))
    vc = (df.select(items.alias("i")).select("i.*").where(F.col("v").isNotNull())
            .groupBy("attr", "v").agg(F.count(F.lit(1)).cast("long").alias("cnt")))
    # rarest (count, value) per attr, then the rarest among the rest: two aggregates,
    # no attribute's values are ever gathered into one row or task
    first = vc.groupBy("attr").agg(F.min(F.struct("cnt", "v")).alias("r1"))
    rest = vc.join(first, "attr").where(~((F.col("cnt") == F.col("r1.cnt")) & (F.col("v") == F.col("r1.v"))))
    second = rest.groupBy("attr").agg(F.min(F.struct("cnt", "v")).alias("r2"))
    return second.join(first, "attr").select("attr", F.col("r2.v").alias("from_value"), F.col("r1.v").alias("to_value"))
