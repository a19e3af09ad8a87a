"""Statistics of all group pairs from one table of per-value counters.

The result of a pair statistic has one row for each pair of groups, so the group names are no
larger than it and become counter columns: one aggregate turns the rows into ``(attr, v,
counter of every group of every protected attribute)``.  Each pair's statistic is then an
aggregate expression over that table; nothing is copied per pair or per group.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.operators.sizing import written

PAIR = ["protected", "g1", "g2"]
PAIRS_PER_PASS = 40       # pairs of one aggregate; more pairs take further passes, each written by itself

Slots = dict[str, list[str]]


def group_label(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("NaN"))


def group_slots(grp: DataFrame) -> Slots:
    """Sorted group names of each protected attribute, from rows with ``protected`` and ``g``."""
    rows = grp.groupBy("protected").agg(F.sort_array(F.collect_set("g")).alias("gs")).collect()
    return {r["protected"]: list(r["gs"]) for r in sorted(rows, key=lambda r: r["protected"])}


def counters(slots: Slots) -> list[tuple[str, int, str]]:
    return [(p, i, f"c{j}_{i}") for j, (p, gs) in enumerate(slots.items()) for i in range(len(gs))]


def wide_counts(df: DataFrame, slots: Slots, cols, numeric: bool) -> DataFrame:
    """``(attr, v, counters...)``; null values left out; ``v`` double or string."""
    cols = list(cols)
    slot = []
    for j, (p, gs) in enumerate(slots.items()):
        at = F.create_map(*[x for i, g in enumerate(gs) for x in (F.lit(g), F.lit(i))])
        slot.append(at[group_label(p)].alias(f"s{j}"))
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("attr"), F.col(c).cast("double" if numeric else "string").alias("v"))
                                for i, c in enumerate(cols)]))
    rows = df.select(*slot, items.alias("i")).select(*[f"s{j}" for j in range(len(slots))], "i.attr", "i.v").where(F.col("v").isNotNull())
    names = list(slots)
    wide = rows.groupBy("attr", "v").agg(*[
        F.sum((F.col(f"s{names.index(p)}") == i).cast("long")).alias(c) for p, i, c in counters(slots)])
    # attributes travel as numbers and get their names afterwards
    return wide.withColumn("attr", F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("attr") + 1))


def merge_values(wide: DataFrame, slots: Slots, v: Column) -> DataFrame:
    """The counters after the values were rewritten."""
    return wide.withColumn("v", v).groupBy("attr", "v").agg(*[F.sum(c).alias(c) for _, _, c in counters(slots)])


def with_totals(wide: DataFrame, slots: Slots, *more: Column) -> DataFrame:
    """Adds each counter's total ``n_<counter>`` over the attribute, and ``more`` aggregates: one row for
    each attribute, which is broadcast (a join by it would bring all rows of an attribute to one task)."""
    tot = wide.groupBy("attr").agg(*[F.sum(c).alias(f"n_{c}") for _, _, c in counters(slots)], *more)
    return wide.join(F.broadcast(tot), "attr")


def pair_aggregate(wide: DataFrame, slots: Slots, make: Callable[[str, str], dict[str, Column]]) -> DataFrame:
    """``(protected, g1, g2, attr, <names>)``: ``make(counter 1, counter 2)`` gives the aggregates of one pair."""
    name = {(p, i): c for p, i, c in counters(slots)}
    pairs = [(p, i, k) for p, gs in slots.items() for i, k in combinations(range(len(gs)), 2)]
    out, several = None, len(pairs) > PAIRS_PER_PASS
    if several:
        wide = written(wide, "counters")
    for start in range(0, max(len(pairs), 1), PAIRS_PER_PASS):
        aggs, rows = [], []
        for x, (p, i, k) in enumerate(pairs[start:start + PAIRS_PER_PASS]):
            made = make(name[p, i], name[p, k])
            aggs += [col.alias(f"{n}_{x}") for n, col in made.items()]
            rows.append(F.struct(F.lit(p).alias("protected"), F.lit(slots[p][i]).alias("g1"), F.lit(slots[p][k]).alias("g2"),
                                 *[F.col(f"{n}_{x}").alias(n) for n in made]))
        if not rows:
            none = make("c", "c")
            empty = wide.limit(0).select(*[F.lit("").alias(x) for x in PAIR], "attr", F.lit(0).cast("long").alias("c"),
                                         F.lit(0).cast("long").alias("n_c"), F.lit(0).cast("long").alias("cum_c"), "v")
            return empty.withColumn("shift", F.lit(0.0)).groupBy(*PAIR, "attr").agg(*[c.alias(n) for n, c in none.items()])
        part = wide.groupBy("attr").agg(*aggs).select("attr", F.explode(F.array(*rows)).alias("x")) \
            .select("x.protected", "x.g1", "x.g2", "attr", *[f"x.{n}" for n in make(*[name[pairs[0][0], 0]] * 2)])
        if several:                             # keeps the expressions of one plan few
            part = written(part, "pairs")
        out = part if out is None else out.unionByName(part)
    return out
