"""Bias concentration (epsilon) of each feature for each protected attribute.

Pipeline (one plan per call, all protected attributes together):

1. per-group moments by GROUPING SETS over the protected columns
   (numeric count/sum/min/max) with map-side combine;
2. the difference table S(protected, g1, g2, attr): num-a from the group
   moments; the others from one table of per-value counters of all groups
   (``pairs``): num-b (KS) and num-c (1/2 sum |x - y|) from sliced running
   counts, cat-a / cat-b from the counters themselves;
3. optional per-pair scaling (min | mean | sigma);
4. epsilon in closed form.  With the default order h = p - 1 the attribute
   distance is d(a, b) = |u_a - u_b| / p where u_a is the mean over pairs of
   R(X minus a) (root mean square of S over the other attributes), so the
   multidimensional-scaling embedding is one-dimensional and
   epsilon_a = |u_a - mean(u)| / p.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.operators.pairs import (PAIR, Slots, counters, group_label, group_slots, merge_values,  # noqa: F401
                                      pair_aggregate, wide_counts, with_totals)
from equilens.operators.prefix import running_sums
from equilens.operators.sizing import written
from equilens.spec import AuditSpec, EpsilonConfig


def numeric_group_stats(df: DataFrame, protected, num) -> DataFrame:
    """``(protected, g, attr, cnt, s, mn, mx)`` by one GROUPING SETS aggregate."""
    protected, num = list(protected), list(num)
    aggs = []
    for i, c in enumerate(num):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"c{i}"), F.sum(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    aggs += [F.grouping(p).alias(f"_g{j}") for j, p in enumerate(protected)]
    agg = df.groupingSets([[p] for p in protected], *protected).agg(*aggs)
    which, grp = F.lit(None).cast("string"), F.lit(None).cast("string")
    for j, p in enumerate(protected):
        which = F.when(F.col(f"_g{j}") == 0, F.lit(p)).otherwise(which)
        grp = F.when(F.col(f"_g{j}") == 0, group_label(p)).otherwise(grp)
    rows = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"c{i}").alias("cnt"), F.col(f"s{i}").alias("s"),
                              F.col(f"l{i}").alias("mn"), F.col(f"h{i}").alias("mx")) for i, c in enumerate(num)])
    return (agg.select(which.alias("protected"), grp.alias("g"), "_rows", F.explode(rows).alias("r"))
               .select("protected", "g", "_rows", "r.*"))


def groups(df: DataFrame, protected) -> DataFrame:
    protected = list(protected)
    agg = df.groupingSets([[p] for p in protected], *protected).agg(
        F.count(F.lit(1)).alias("rows"), *[F.grouping(p).alias(f"_g{j}") for j, p in enumerate(protected)])
    which, grp = F.lit(None).cast("string"), F.lit(None).cast("string")
    for j, p in enumerate(protected):
        which = F.when(F.col(f"_g{j}") == 0, F.lit(p)).otherwise(which)
        grp = F.when(F.col(f"_g{j}") == 0, group_label(p)).otherwise(grp)
    return agg.select(which.alias("protected"), grp.alias("g"), "rows")


# ---- S: numeric -----------------------------------------------------------
def _pair_stats(st: DataFrame) -> DataFrame:
    a, b = st.alias("a"), st.alias("b")
    j = a.join(b, (F.col("a.protected") == F.col("b.protected")) & (F.col("a.attr") == F.col("b.attr"))
               & (F.col("a.g") < F.col("b.g")))
    return j.select(F.col("a.protected").alias("protected"), F.col("a.g").alias("g1"), F.col("b.g").alias("g2"),
                    F.col("a.attr").alias("attr"),
                    F.col("a.cnt").alias("n1"), F.col("b.cnt").alias("n2"),
                    F.try_divide(F.col("a.s"), F.col("a.cnt")).alias("m1"),
                    F.try_divide(F.col("b.s"), F.col("b.cnt")).alias("m2"),
                    F.least("a.mn", "b.mn").alias("lo"), F.greatest("a.mx", "b.mx").alias("hi"))


def _scaled(expr, lo="lo", hi="hi"):
    rng = F.col(hi) - F.col(lo)
    return F.when(rng != 0, F.try_divide(expr, rng)).otherwise(expr)


def diff_num_a(st: DataFrame) -> DataFrame:
    """|mean_1 - mean_2| of values min-max scaled over the two groups' rows."""
    ps = _pair_stats(st)
    return ps.select(*PAIR, "attr", _scaled(F.abs(F.col("m1") - F.col("m2"))).alias("s"))


def diff_num_b_c(st: DataFrame, wide: DataFrame, slots: Slots) -> DataFrame:
    """KS statistic (num-b) and 1/2 sum over pairs of rows |x - y| of scaled values (num-c).

    num-c uses sum_{i,j} |x_i - y_j| = sum_v (v - c) [a_v (B_<(v) - B_>(v)) + b_v (A_<(v) - A_>(v))]
    for any shift c, which needs only inclusive running counts.  One ordered pass over the
    distinct values of each attribute gives the running counts of all groups of all protected
    attributes; every pair's statistic is an aggregate expression over it.
    """
    cs = [c for _, _, c in counters(slots)]
    tot = wide.groupBy("attr").agg(*[F.sum(c).alias(f"n_{c}") for c in cs], F.min("v").alias("shift"))
    # one row for each attribute: a join by it would bring all rows of an attribute to one task
    ranked = running_sums(wide, ["attr"], ["v"], cs).join(F.broadcast(tot), "attr")

    def pair(one: str, two: str) -> dict:
        a, b, A, B = F.col(one), F.col(two), F.col(f"cum_{one}"), F.col(f"cum_{two}")
        n1, n2 = F.col(f"n_{one}"), F.col(f"n_{two}")
        term = (F.col("v") - F.col("shift")) * (a * ((B - b) - (n2 - B)) + b * ((A - a) - (n1 - A)))
        return {"ks": F.max(F.abs(F.try_divide(A, n1) - F.try_divide(B, n2))), "raw": F.sum(term)}

    out = pair_aggregate(ranked, slots, pair).join(_pair_stats(st), PAIR + ["attr"])
    return out.select(*PAIR, "attr", F.col("ks").alias("s_b"), (0.5 * _scaled(F.col("raw"))).alias("s_c"))


# ---- S: categorical --------------------------------------------------------
def diff_cat(wide: DataFrame, slots: Slots) -> DataFrame:
    """cat-a: (1/K) sum |share_1 - share_2| over the K values either group has; cat-b: 1/2 sum (n1-n2)^2/(n1+n2)."""
    def pair(one: str, two: str) -> dict:
        n1, n2 = F.col(one), F.col(two)
        seen = (n1 > 0) | (n2 > 0)
        share = F.abs(F.try_divide(n1, F.col(f"n_{one}")) - F.try_divide(n2, F.col(f"n_{two}")))
        return {"k": F.count(F.when(seen, 1)), "share": F.sum(F.when(seen, share)),
                "chi": F.sum(F.try_divide(F.pow(n1 - n2, 2), n1 + n2))}

    out = pair_aggregate(with_totals(wide, slots), slots, pair).where("k > 0")
    return out.select(*PAIR, "attr", F.try_divide("share", "k").alias("s_a"), (0.5 * F.col("chi")).alias("s_b"))


# ---- S assembly, scaling and epsilon --------------------------------------------
def scale_s(s: DataFrame, how: str) -> DataFrame:
    """Per pair and kind: ``min`` (divide by min), ``mean`` (divide by mean), ``sigma``
    (z-score by sample std then minus min); anything else leaves S unscaled."""
    w = Window.partitionBy(*PAIR, "kind")
    if how == "min":
        return s.withColumn("s", F.try_divide(F.col("s"), F.min("s").over(w)))
    if how == "mean":
        return s.withColumn("s", F.try_divide(F.col("s"), F.avg("s").over(w)))
    if how == "sigma":
        z = s.withColumn("s", F.try_divide(F.col("s") - F.avg("s").over(w), F.stddev_samp("s").over(w)))
        return z.withColumn("s", F.col("s") - F.min("s").over(w))
    return s


def difference_table(df: DataFrame, spec: AuditSpec, cfg: EpsilonConfig = EpsilonConfig()) -> DataFrame:
    """``(protected, g1, g2, attr, kind, s)``: the per-pair difference of every feature."""
    protected = list(spec.protected)
    num = [c for c in spec.numerical if c not in protected and c != spec.target]
    cat = [c for c in spec.categorical if c not in protected and c != spec.target]
    parts = []
    st = numeric_group_stats(df, protected, num) if num else None
    slots = None
    if cat or cfg.num != "num-a":
        # the groups come with the numeric aggregate where there is one; it has a row for each group and feature
        st = written(st, "moments") if st is not None else None
        slots = group_slots(st if st is not None else groups(df, protected))
    if num:
        if cfg.num == "num-a":
            sn = diff_num_a(st)
        else:
            bc = diff_num_b_c(st, wide_counts(df, slots, num, True), slots)
            sn = bc.select(*PAIR, "attr", F.col("s_b" if cfg.num == "num-b" else "s_c").alias("s"))
        parts.append(sn.withColumn("kind", F.lit("numerical")))
    if cat:
        dc = diff_cat(wide_counts(df, slots, cat, False), slots)
        parts.append(dc.select(*PAIR, "attr", F.col("s_a" if cfg.cat == "cat-a" else "s_b").alias("s"))
                     .withColumn("kind", F.lit("categorical")))
    s = parts[0]
    for p in parts[1:]:
        s = s.unionByName(p)
    return scale_s(s.select(*PAIR, "attr", "kind", "s"), cfg.scale)


def leave_one_out(s: DataFrame, how: str = "d1A", by=()) -> DataFrame:
    """``(by..., protected, g1, g2, attr, r)`` with r = R(all attributes except attr) of that pair.

    d1A: sqrt(mean of S^2), d1B: sqrt(sum of S^2); null S is skipped and
    lowers the divisor.  Uses the pair total T = sum S^2 (window over p rows).
    ``by`` evaluates several alternative S tables (e.g. candidates) at once.
    """
    by = list(by)
    w = Window.partitionBy(*by, *PAIR)
    sq = F.pow(F.col("s"), 2)
    t = s.select("*", F.sum(sq).over(w).alias("_t"), F.count("s").over(w).alias("_c"))
    own = F.coalesce(sq, F.lit(0.0))
    rest_n = F.col("_c") - F.when(F.col("s").isNotNull(), 1).otherwise(0)
    rest = F.greatest(F.col("_t") - own, F.lit(0.0))
    r = F.sqrt(rest / rest_n) if how == "d1A" else F.sqrt(rest)
    return t.select(*by, *PAIR, "attr", F.when(rest_n > 0, r).alias("r"))


def attribute_scores(s: DataFrame, how: str = "d1A", by=()) -> DataFrame:
    """``(by..., protected, attr, u, p)``: u = mean over pairs of R(X minus attr)."""
    by = list(by)
    loo = leave_one_out(s, how, by)
    u = loo.groupBy(*by, "protected", "attr").agg(F.avg("r").alias("u"))
    return u.withColumn("p", F.count(F.lit(1)).over(Window.partitionBy(*by, "protected")))


def attribute_distance(s: DataFrame, how: str = "d1A") -> DataFrame:
    """``(protected, a1, a2, dist)`` = |u_a1 - u_a2| / p for a1 < a2 (p x p per protected)."""
    u = attribute_scores(s, how)
    a, b = u.alias("a"), u.alias("b")
    return (a.join(b, (F.col("a.protected") == F.col("b.protected")) & (F.col("a.attr") < F.col("b.attr")))
             .select(F.col("a.protected").alias("protected"), F.col("a.attr").alias("a1"),
                     F.col("b.attr").alias("a2"), (F.abs(F.col("a.u") - F.col("b.u")) / F.col("a.p")).alias("dist")))


def epsilon_from_s(s: DataFrame, how: str = "d1A", by=()) -> DataFrame:
    """``(by..., protected, attr, epsilon)``: distance of each attribute from the embedding centre."""
    by = list(by)
    u = attribute_scores(s, how, by)
    w = Window.partitionBy(*by, "protected")
    return u.select(*by, "protected", "attr", (F.abs(F.col("u") - F.avg("u").over(w)) / F.col("p")).alias("epsilon"))


def epsilon(df: DataFrame, spec: AuditSpec, cfg: EpsilonConfig = EpsilonConfig()) -> DataFrame:
    return epsilon_from_s(difference_table(df, spec, cfg), cfg.sum)


def max_epsilon(eps: DataFrame, exclude=()) -> DataFrame:
    """The (protected, attr) with the largest epsilon; ties by protected then attr; dropped excluded."""
    e = eps.where(~F.col("attr").isin(list(exclude))) if exclude else eps
    # min of (-epsilon, protected, attr): an aggregate (partial + final), not a global window
    best = e.agg(F.min(F.struct((-F.col("epsilon")).alias("k"), "protected", "attr")).alias("b"))
    return best.select("b.protected", "b.attr", (-F.col("b.k")).alias("epsilon")).where(F.col("attr").isNotNull())


def mean_epsilon(eps: DataFrame) -> DataFrame:
    """Mean over all (protected, attr) plus one zero 'origin' entry per protected attribute."""
    per = eps.groupBy("protected").agg(F.sum("epsilon").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("t") / F.sum(F.col("n") + 1)).alias("mean_epsilon"))


# ---- general order h (subsets of size >= h) ----------------------------------------------
MAX_SUBSETS = 1 << 20       # subsets of h or more attributes that are worked through


def subset_scores(s: DataFrame, attrs, min_size: int, how: str = "d1A") -> DataFrame:
    """``(protected, left_out, U)``: U = mean over group pairs of R(subset) for every subset of
    ``attrs`` with at least ``min_size`` members (one at least), named by the ascending positions it leaves out.

    Each pair's row carries its squared scores and is exploded into its subsets, so the work follows
    their number, sum of C(p, k) for k up to p - min_size, at any p; above ``MAX_SUBSETS`` it raises.
    """
    attrs = list(attrs)
    p = len(attrs)
    most = p - max(min_size, 1)                    # attributes a subset may leave out
    n = sum(math.comb(p, k) for k in range(most + 1))
    if n > MAX_SUBSETS:
        raise ValueError(f"order-h epsilon: {n} subsets of {min_size} or more of {p} attributes exceed {MAX_SUBSETS}")
    spark = s.sparkSession
    idx = spark.createDataFrame([(a, i) for i, a in enumerate(attrs)], "attr string, bit int")
    sq = F.pow(F.col("s"), 2)
    terms = F.array_sort(F.collect_list(F.when(sq.isNotNull(), F.struct("bit", sq.alias("sq")))))
    rows = s.join(F.broadcast(idx), "attr").groupBy("protected", "g1", "g2").agg(terms.alias("terms")) \
        .withColumns({"left_out": F.array().cast("array<int>"), "last": F.lit(-1)})
    for k in range(most):
        # a set is ended (null) or goes on with a later position
        more = F.when(F.col("last") < p - 1, F.sequence(F.col("last") + 1, F.lit(p - 1))).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn("next", F.explode(F.concat(F.array(F.lit(None).cast("int")), more)))
        if k == 0:
            rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "protected", "g1", "g2", "next")
        rows = rows.withColumns({"left_out": F.when(F.col("next").isNull(), F.col("left_out")).otherwise(F.array_append("left_out", F.col("next"))),
                                 "last": F.coalesce("next", F.lit(p))}).drop("next")
    kept = F.transform(F.filter("terms", lambda t: ~F.array_contains(F.col("left_out"), t["bit"])), lambda t: t["sq"])
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    r = F.when(F.size(kept) > 0, F.sqrt(total / F.size(kept) if how == "d1A" else total))
    return rows.select("protected", "left_out", r.alias("r")).groupBy("protected", "left_out").agg(F.avg("r").alias("U"))


def attribute_distance_order_h(s: DataFrame, attrs, h: int, how: str = "d1A") -> DataFrame:
    """d(a, b) = (1/N) sum over subsets t of the other attributes with |t| >= h - 1 of
    |U(t + a) - U(t + b)|, N counting also the subsets that contain the zero 'origin' element."""
    attrs = list(attrs)
    p = len(attrs)
    u = subset_scores(s, attrs, h, how)
    n_sub = sum(math.comb(p - 1, k) for k in range(max(h - 1, 0), p))
    # t + a leaves out b and holds an earlier a; its partner t + b leaves out a in place of b
    cand = u.withColumn("ib", F.explode("left_out")) \
        .withColumn("ia", F.explode(F.when(F.col("ib") > 0, F.array_except(F.sequence(F.lit(0), F.col("ib") - 1), F.col("left_out"))))) \
        .select("protected", "ia", "ib", F.col("U").alias("U1"),
                F.array_sort(F.array_append(F.array_remove("left_out", F.col("ib")), F.col("ia"))).alias("left_out"))
    d = cand.join(u, ["protected", "left_out"])
    name = F.array(*[F.lit(a) for a in attrs])
    return d.groupBy("protected", "ia", "ib").agg((F.sum(F.abs(F.col("U1") - F.col("U"))) / n_sub).alias("dist")) \
        .select("protected", F.get(name, F.col("ia")).alias("a1"), F.get(name, F.col("ib")).alias("a2"), "dist")


def epsilon_from_distance(dist: DataFrame) -> DataFrame:
    """Distance of each attribute from the centroid of the exact (classical) embedding of a
    distance table: eps_a^2 = mean_j d_aj^2 - mean_jk d_jk^2 / 2 (Gower)."""
    both = dist.select("protected", F.col("a1").alias("a"), F.col("a2").alias("b"), "dist").unionByName(
        dist.select("protected", F.col("a2").alias("a"), F.col("a1").alias("b"), "dist"))
    attrs = both.select("protected", "a").distinct()
    p = attrs.groupBy("protected").agg(F.count(F.lit(1)).alias("p"))
    row = both.groupBy("protected", "a").agg(F.sum(F.pow("dist", 2)).alias("ra"))
    tot = both.groupBy("protected").agg(F.sum(F.pow("dist", 2)).alias("t"))
    e = row.join(tot, "protected").join(p, "protected")
    v = F.col("ra") / F.col("p") - F.col("t") / (2 * F.col("p") * F.col("p"))
    return e.select("protected", F.col("a").alias("attr"), F.sqrt(F.greatest(v, F.lit(0.0))).alias("epsilon"))


def epsilon_order_h(df: DataFrame, spec: AuditSpec, h: int | None = None, cfg: EpsilonConfig = EpsilonConfig()):
    s = difference_table(df, spec, cfg)
    attrs = [a for a in spec.features if a not in spec.protected and a != spec.target]
    h = len(attrs) - 1 if h is None else h
    return epsilon_from_distance(attribute_distance_order_h(s, attrs, h, cfg.sum))


# ---- num-d: signed pairwise squared-euclidean term, exact from moments ------------------------
def num_d_terms(df: DataFrame, protected, num, subsets, scale: str = "zscore") -> dict:
    """{(protected, subset): num_temp} for the 'num-d' mode with the sqeuclidean metric.

    num_temp = (1/n^2) sum_{i<j} D'_ij (2 [same group] - 1) over all rows, D the squared
    euclidean distance on the subset's columns, D' scaled over all n^2 cells (diagonal
    included): zscore (population std), mean, or min (smallest row mean).  Everything
    follows from per-dimension moments of the centred values, gathered in ONE grouping-sets
    aggregate (d^2 sums); rows with a null feature are left out.
    """
    num, protected = list(num), list(protected)
    d = len(num)
    rows = df.where(F.greatest(*[F.col(c).isNull() for c in num]) == False) if d > 1 else \
        df.where(F.col(num[0]).isNotNull())  # noqa: E712
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in num]).first()
    xt = [F.col(c).cast("double") - F.lit(means[c] or 0.0) for c in num]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(xt[k]).alias(f"s{k}") for k in range(d)]
    aggs += [F.sum(xt[k] * xt[k]).alias(f"q{k}") for k in range(d)]
    aggs += [F.sum(xt[k] * xt[l]).alias(f"m{k}_{l}") for k in range(d) for l in range(k, d)]
    aggs += [F.sum(xt[k] * xt[k] * xt[l] * xt[l]).alias(f"r{k}_{l}") for k in range(d) for l in range(k, d)]
    subs = [tuple(s) for s in subsets]
    aggs += [F.min(sum((xt[num.index(c)] * xt[num.index(c)] for c in s), F.lit(0.0))).alias(f"mn{i}")
             for i, s in enumerate(subs)]
    aggs += [F.grouping(p).alias(f"_g{j}") for j, p in enumerate(protected)]
    res = rows.groupingSets([[]] + [[p] for p in protected], *protected).agg(*aggs).collect()
    glob = [r for r in res if all(r[f"_g{j}"] == 1 for j in range(len(protected)))][0]
    out = {}
    n = glob["n"]
    for j, p in enumerate(protected):
        grp = [r for r in res if r[f"_g{j}"] == 0]
        for i, s in enumerate(subs):
            ks = [num.index(c) for c in s]
            if not ks or n < 2:
                out[(p, s)] = 0.0
                continue
            key = lambda a, b: f"{min(a, b)}_{max(a, b)}"
            sa = sum(glob[f"q{k}"] for k in ks)                          # sum_i a_i (s = 0 after centring)
            t = n * sa                                                   # sum_{i<j} D_ij
            sum_a2 = sum(glob[f"r{key(k, l)}"] for k in ks for l in ks)
            frob = sum(glob[f"m{key(k, l)}"] ** 2 for k in ks for l in ks)
            d2 = 2 * n * sum_a2 + 2 * sa * sa + 4 * frob                 # sum over n^2 cells of D^2
            mu = 2 * t / (n * n)
            wd = sum(r["n"] * sum(r[f"q{k}"] for k in ks) - sum(r[f"s{k}"] ** 2 for k in ks) for r in grp)
            w = sum(r["n"] * (r["n"] - 1) / 2 for r in grp)
            pp = n * (n - 1) / 2
            signed = 2 * wd - t                                           # sum_{i<j} D (2 delta - 1)
            if scale == "zscore":
                var = d2 / (n * n) - mu * mu
                val = (signed - mu * (2 * w - pp)) / math.sqrt(var) if var > 0 else float("nan")
            elif scale == "mean":
                val = signed / mu if mu else float("nan")
            elif scale == "min":
                m = glob[f"mn{i}"] + sa / n
                val = signed / m if m else float("nan")
            else:
                val = signed
            out[(p, s)] = val / (n * n)
    return out


def _complete(df: DataFrame, cols) -> DataFrame:
    """Rows without a null in ``cols``, these as doubles around their mean (pair distances don't change)."""
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    mean = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return rows.select(*[F.col(x) if x not in cols else (F.col(x).cast("double") - F.lit(mean[x] or 0.0)).alias(x)
                         for x in rows.columns])


def num_d_cityblock_terms(df: DataFrame, protected, num, subsets, scale: str = "none") -> dict:
    """``num_d_terms`` for the city-block distance and scale none, mean or min.

    The distance adds up over the columns, and sum_{i<j} |x_i - x_j| = sum_v c_v (v C(v) - W(v)) with
    the count C and the sum W of all smaller values: sliced running sums of the value counts of
    all rows and of each group.  ``min`` needs each row's mean distance, which joins every
    column's value table to the rows.
    """
    if scale not in ("none", "mean", "min"):
        raise ValueError("num-d with the city-block distance is exact for scale none, mean and min")
    protected, num = list(protected), list(num)
    rows = _complete(df.select(*dict.fromkeys([*protected, *num])), num).persist()
    n = rows.count()
    parts = [F.struct(F.lit(p).alias("protected"), g.alias("g")) for p, g in
             [("", F.lit("")), *[(p, group_label(p)) for p in protected]]]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("v")) for c in num]))
    vc = (rows.select(F.explode(F.array(*parts)).alias("k"), *num).select("k.*", values.alias("i"))
              .groupBy("protected", "g", "i.attr", "i.v").agg(F.count(F.lit(1)).alias("c")).withColumn("w", F.col("c") * F.col("v")))
    key = ["protected", "g", "attr"]
    cum = running_sums(vc, key, ["v"], ["c", "w"])
    below = F.col("v") * (F.col("cum_c") - F.col("c")) - (F.col("cum_w") - F.col("w"))
    sums = cum.groupBy("protected", "attr").agg(F.sum(F.col("c") * below).alias("t"))
    got = {(r["protected"], r["attr"]): r["t"] for r in sums.collect()}        # one row for each attribute pair
    subs = [tuple(s) for s in subsets]
    low = {}
    if scale == "min" and n:
        allv = cum.where("protected = ''")
        far = allv.select("attr", "v", (F.col("v") * (2 * F.col("cum_c") - n) - 2 * F.col("cum_w")).alias("f"))
        wide = rows.select(*num)
        for c in num:
            own = far.where(F.col("attr") == c).select(F.col("v").alias(c), F.col("f").alias(f"f_{c}"))
            wide = wide.join(own, c)
        aggs = [F.min(sum((F.col(f"f_{c}") for c in s), F.lit(0.0))).alias(f"m{i}") for i, s in enumerate(subs)]
        r = wide.agg(*aggs).first()           # the columns are centred, so their total W is zero
        low = {s: r[f"m{i}"] / n for i, s in enumerate(subs)}
    rows.unpersist()
    out = {}
    for p in protected:
        for s in subs:
            total = sum(got.get(("", c), 0.0) for c in s)
            signed = 2 * sum(got.get((p, c), 0.0) for c in s) - total
            unit = 1.0 if scale == "none" else (2 * total / (n * n) if scale == "mean" and n else low.get(s, 0.0))
            out[(p, s)] = 0.0 if not s or n < 2 else (signed / unit if unit else float("nan")) / (n * n)
    return out


def epsilon_num_d(df: DataFrame, spec: AuditSpec, cfg: EpsilonConfig = EpsilonConfig(), metric: str = "sqeuclidean"):
    """Epsilon in num-d mode (default order): R(sub) = sqrt(mean over the subset's categorical
    attributes of S^2) + num_temp(subset's numeric attributes)."""
    terms_of = {"sqeuclidean": num_d_terms, "cityblock": num_d_cityblock_terms}.get(metric)
    if terms_of is None:
        raise ValueError("num-d is exact for sqeuclidean and cityblock only (others need all row pairs)")
    protected = list(spec.protected)
    num = [c for c in spec.numerical if c not in protected]
    cat = [c for c in spec.categorical if c not in protected]
    feats = num + cat
    p = len(feats)
    subsets = [tuple(num)] + [tuple(c for c in num if c != a) for a in num]
    terms = terms_of(df, protected, num, subsets, cfg.scale)
    spark = df.sparkSession
    slots = group_slots(groups(df, protected))
    s_cat = diff_cat(wide_counts(df, slots, cat, False), slots) \
        .select(*PAIR, "attr", F.col("s_a" if cfg.cat == "cat-a" else "s_b").alias("s"))
    # per pair: sum and count of S^2 over all categorical attributes, minus the left-out one
    w = Window.partitionBy(*PAIR)
    base = s_cat.select(*PAIR, "attr", F.pow("s", 2).alias("sq"))
    tot = base.groupBy(*PAIR).agg(F.sum("sq").alias("t"), F.count("sq").alias("c"))
    left = []
    for a in feats:
        num_sub = tuple(c for c in num if c != a)
        nt = F.create_map(*[x for pr in protected for x in (F.lit(pr), F.lit(float(terms[(pr, num_sub)])))])
        if a in cat:
            own = base.where(F.col("attr") == a).select(*PAIR, F.col("sq").alias("own"))
            r = tot.join(own, PAIR, "left").select(
                *PAIR, F.lit(a).alias("attr"),
                (F.sqrt(F.try_divide(F.col("t") - F.coalesce("own", F.lit(0.0)),
                                     F.col("c") - F.when(F.col("own").isNotNull(), 1).otherwise(0)))
                 + nt[F.col("protected")]).alias("r"))
        else:
            r = tot.select(*PAIR, F.lit(a).alias("attr"),
                           (F.sqrt(F.try_divide(F.col("t"), F.col("c"))) + nt[F.col("protected")]).alias("r"))
        left.append(r)
    loo = left[0]
    for r in left[1:]:
        loo = loo.unionByName(r)
    u = loo.groupBy("protected", "attr").agg(F.avg("r").alias("u"))
    wp = Window.partitionBy("protected")
    return u.select("protected", "attr", (F.abs(F.col("u") - F.avg("u").over(wp)) / F.lit(p)).alias("epsilon"))
