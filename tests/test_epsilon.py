import itertools
import math
import random
from itertools import combinations

import pytest

from equilens.operators import epsilon as E
from equilens.spec import AuditSpec, EpsilonConfig


def _rows(n=120, seed=5):
    rnd = random.Random(seed)
    return [(rnd.choice("PQR"), rnd.randint(0, 9) * 1.5, round(rnd.gauss(3, 2), 2), rnd.choice("xyz"), rnd.choice("uv"))
            for _ in range(n)]


SCHEMA = "o string, n1 double, n2 double, c1 string, c2 string"
SPEC = AuditSpec("y", ("o",), ("n1", "n2"), ("c1", "c2"))


def _brute_s(rows, cfg):
    """Per pair and attribute difference, straight from the definitions."""
    groups = sorted(set(r[0] for r in rows))
    out = {}
    for g1, g2 in itertools.combinations(groups, 2):
        a = [r for r in rows if r[0] == g1]
        b = [r for r in rows if r[0] == g2]
        for i, name in ((1, "n1"), (2, "n2")):
            xa, xb = [r[i] for r in a], [r[i] for r in b]
            lo, hi = min(xa + xb), max(xa + xb)
            sc = (lambda v: (v - lo) / (hi - lo)) if hi != lo else (lambda v: v)
            if cfg == "num-a":
                s = abs(sum(map(sc, xa)) / len(xa) - sum(map(sc, xb)) / len(xb))
            elif cfg == "num-b":
                s = max(abs(sum(x <= v for x in xa) / len(xa) - sum(x <= v for x in xb) / len(xb)) for v in xa + xb)
            else:
                s = 0.5 * sum(abs(sc(x) - sc(y)) for x in xa for y in xb)
            out[(g1, g2, name)] = s
        for i, name in ((3, "c1"), (4, "c2")):
            va, vb = [r[i] for r in a], [r[i] for r in b]
            cats = sorted(set(va) | set(vb))
            out[(g1, g2, name)] = sum(abs(va.count(c) / len(va) - vb.count(c) / len(vb)) for c in cats) / len(cats)
    return out


@pytest.mark.parametrize("num", ["num-a", "num-b", "num-c"])
def test_difference_table_matches_definitions(spark, num):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["g1"], r["g2"], r["attr"]): r["s"] for r in E.difference_table(df, SPEC, EpsilonConfig(num=num)).collect()}
    ref = _brute_s(rows, num)
    assert got.keys() == ref.keys()
    for k in ref:
        assert got[k] == pytest.approx(ref[k], rel=1e-9, abs=1e-9)


def _mean_rms(S, attrs):
    """U by bitmask: the mean over group pairs of the root mean square of S over the mask's attributes."""
    out = [0.0]
    for mask in range(1, 1 << len(attrs)):
        sq = [[row[a] ** 2 for i, a in enumerate(attrs) if mask >> i & 1] for row in S.values()]
        out.append(sum(math.sqrt(sum(x) / len(x)) for x in sq) / len(sq))
    return out


def _distance(S, attrs, i, j, h):
    """Mean of |U(t + i) - U(t + j)| over the sets t of h - 1 or more of the other attributes and one
    extra element; a set that holds the extra element counts with 0."""
    u, p = _mean_rms(S, attrs), len(attrs)
    free = ((1 << p) - 1) & ~(1 << i | 1 << j)
    total, t = 0.0, free
    while True:
        if t.bit_count() >= h - 1:
            total += abs(u[t | 1 << i] - u[t | 1 << j])
        if t == 0:
            break
        t = (t - 1) & free
    return total / sum(math.comb(p - 1, k) for k in range(max(h - 1, 0), p))


def test_closed_form_distance_and_epsilon_match_subset_definition(spark):
    rnd = random.Random(2)
    attrs = ["a", "b", "c", "d", "e"]
    pairs = [("G1", "G2"), ("G1", "G3"), ("G2", "G3")]
    S = {pr: {a: rnd.random() for a in attrs} for pr in pairs}
    sdf = spark.createDataFrame([("o", g1, g2, a, "numerical", S[(g1, g2)][a]) for (g1, g2) in pairs for a in attrs],
                                "protected string, g1 string, g2 string, attr string, kind string, s double")
    dist = {(r["a1"], r["a2"]): r["dist"] for r in E.attribute_distance(sdf).collect()}
    for i, j in itertools.combinations(range(len(attrs)), 2):
        assert dist[(attrs[i], attrs[j])] == pytest.approx(_distance(S, attrs, i, j, len(attrs) - 1), rel=1e-12)
    eps = {r["attr"]: r["epsilon"] for r in E.epsilon_from_s(sdf).collect()}
    # the embedding x_a = +-epsilon_a is centred and reproduces every distance (zero stress)
    u = {r["attr"]: r["u"] for r in E.attribute_scores(sdf).collect()}
    ubar = sum(u.values()) / len(u)
    x = {a: (u[a] - ubar) / len(attrs) for a in attrs}
    assert sum(x.values()) == pytest.approx(0.0, abs=1e-15)
    for a in attrs:
        assert eps[a] == pytest.approx(abs(x[a]))
    for a1, a2 in itertools.combinations(attrs, 2):
        assert abs(x[a1] - x[a2]) == pytest.approx(dist[(a1, a2)])


def test_mean_epsilon_counts_origin(spark):
    e = spark.createDataFrame([("o", "a", 0.3), ("o", "b", 0.1)], "protected string, attr string, epsilon double")
    assert E.mean_epsilon(e).first()["mean_epsilon"] == pytest.approx(0.4 / 3)
    assert E.max_epsilon(e, exclude=["a"]).first()["attr"] == "b"


def test_pair_statistics_do_not_depend_on_the_passes(spark, monkeypatch):
    from equilens.operators import pairs
    rows = [(f"G{i % 7}", *r[1:]) for i, r in enumerate(_rows(140, seed=9))]
    df = spark.createDataFrame(rows, SCHEMA)
    for cfg in (EpsilonConfig(num="num-b", cat="cat-b"), EpsilonConfig(num="num-c")):
        got = []
        for n in (200, 4):
            monkeypatch.setattr(pairs, "PAIRS_PER_PASS", n)
            got.append({(r["g1"], r["g2"], r["attr"]): r["s"] for r in E.difference_table(df, SPEC, cfg).collect()})
        assert got[0].keys() == got[1].keys() and len(got[0]) == 21 * 4
        for k in got[0]:
            assert got[0][k] == pytest.approx(got[1][k])


def test_one_group_has_no_pairs(spark):
    df = spark.createDataFrame([("P", 1.0, 2.0, "x", "u")], SCHEMA)
    for cfg in (EpsilonConfig(), EpsilonConfig(num="num-b", cat="cat-b")):
        assert E.difference_table(df, SPEC, cfg).count() == 0


def test_running_sums_on_a_million_rows_with_payload(spark):
    """Slices of one key over many tasks, with a column the sums don't use."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from equilens.operators.prefix import running_sums
    df = spark.range(0, 1_000_000, numPartitions=8).select(
        F.lit("k").alias("k"), F.xxhash64("id").cast("double").alias("v"), (F.col("id") % 5).alias("c"),
        F.concat(F.lit("row "), F.col("id").cast("string")).alias("payload"))
    got = running_sums(df, ["k"], ["v"], ["c"], n_slices=16)
    ref = df.select("v", F.sum("c").over(Window.partitionBy("k").orderBy("v")).alias("ref"))
    j = got.join(ref, "v")
    assert got.columns == ["k", "v", "c", "payload", "cum_c"]
    assert j.where("cum_c != ref").count() == 0 and j.count() == 1_000_000


def test_running_sums_null_and_small_keys(spark):
    from equilens.operators.prefix import running_sums
    df = spark.createDataFrame([(None, 1.0, 2), (None, 3.0, 5), ("a", 2.0, 1), ("a", 2.5, 1), ("b", -1.0, 9)], "k string, v double, c int")
    got = {(r["k"], r["v"]): r["cum_c"] for r in running_sums(df, ["k"], ["v"], ["c"], n_slices=4).collect()}
    assert got == {(None, 1.0): 2, (None, 3.0): 7, ("a", 2.0): 1, ("a", 2.5): 2, ("b", -1.0): 9}


def test_quantiles_are_exact_and_repeat(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from equilens.operators.prefix import quantile_table, quantile_values
    df = spark.range(0, 300_000).select(F.round(F.rand(3) * 1e5, 1).alias("x"), (F.col("id") % 7).cast("double").alias("y"),
                                        F.lit(None).cast("double").alias("z")).persist()
    x = np.array([r[0] for r in df.select("x").collect()])
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for _ in range(3):
        assert quantile_values(df, "x", qs) == pytest.approx(np.quantile(x, qs).tolist())
    t = quantile_table(df, ["y", "z"], [0.5])
    assert t == {"y": [3.0], "z": [None]}
    df.unpersist()


@pytest.mark.parametrize("h", [2, 3, 4])
def test_order_h_distance_matches_subset_definition(spark, h):
    rnd = random.Random(h)
    attrs = ["a", "b", "c", "d", "e"]
    pairs = [("G1", "G2"), ("G1", "G3"), ("G2", "G3")]
    S = {pr: {a: rnd.random() for a in attrs} for pr in pairs}
    sdf = spark.createDataFrame([("o", g1, g2, a, "numerical", S[(g1, g2)][a]) for (g1, g2) in pairs for a in attrs],
                                "protected string, g1 string, g2 string, attr string, kind string, s double")
    dist = {(r["a1"], r["a2"]): r["dist"] for r in E.attribute_distance_order_h(sdf, attrs, h).collect()}
    for i, j in itertools.combinations(range(len(attrs)), 2):
        assert dist[(attrs[i], attrs[j])] == pytest.approx(_distance(S, attrs, i, j, h), rel=1e-9)
    if h == 4:   # default order p - 1: Gower epsilon equals the closed form
        eps_h = {r["attr"]: r["epsilon"] for r in E.epsilon_from_distance(E.attribute_distance_order_h(sdf, attrs, h)).collect()}
        eps = {r["attr"]: r["epsilon"] for r in E.epsilon_from_s(sdf).collect()}
        for a in attrs:
            assert eps_h[a] == pytest.approx(eps[a], abs=1e-12)


@pytest.mark.parametrize("h", [39, 38])
def test_order_h_of_forty_attributes(spark, h):
    """The subsets are told by what they leave out, as the definition walks them."""
    rnd = random.Random(h)
    p, pairs = 40, [("G1", "G2"), ("G1", "G3")]
    attrs = [f"a{i:02d}" for i in range(p)]
    S = [[rnd.random() for _ in attrs] for _ in pairs]
    sdf = spark.createDataFrame([("o", *pr, a, "numerical", row[i]) for pr, row in zip(pairs, S) for i, a in enumerate(attrs)],
                                "protected string, g1 string, g2 string, attr string, kind string, s double")

    def u(out):
        return sum(math.sqrt(sum(x * x for i, x in enumerate(row) if i not in out) / (p - len(out))) for row in S) / len(S)

    dist = {(r["a1"], r["a2"]): r["dist"] for r in E.attribute_distance_order_h(sdf, attrs, h).collect()}
    assert len(dist) == p * (p - 1) // 2
    n = sum(math.comb(p - 1, k) for k in range(h - 1, p))
    for i, j in itertools.combinations(range(p), 2):
        rest = [k for k in range(p) if k not in (i, j)]
        free = [set(c) for size in range(p - h) for c in itertools.combinations(rest, size)]
        want = sum(abs(u(c | {j}) - u(c | {i})) for c in free) / n
        assert dist[(attrs[i], attrs[j])] == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_order_h_raises_only_above_the_number_of_subsets(spark):
    sdf = spark.createDataFrame([], "protected string, g1 string, g2 string, attr string, kind string, s double")
    attrs = [f"a{i}" for i in range(40)]
    assert E.attribute_distance_order_h(sdf, attrs, 39).count() == 0
    with pytest.raises(ValueError, match="subsets"):
        E.attribute_distance_order_h(sdf, attrs, 20)


def _signed_pair_mean(points, labels, distance, scale):
    """Every unordered pair of rows adds its scaled distance within a label and takes it off across
    labels; the total is shared over all n * n cells.  The scale knows each row's distance to itself, 0."""
    n, pairs, reach = len(points), [], [0.0] * len(points)
    for i, j in combinations(range(n), 2):
        d = distance(points[i], points[j])
        pairs.append((d, 1 if labels[i] == labels[j] else -1))
        reach[i] += d
        reach[j] += d
    mean = sum(reach) / n ** 2
    if scale == "zscore":
        spread = math.sqrt(2 * sum(d * d for d, _ in pairs) / n ** 2 - mean * mean)
        return sum(sign * (d - mean) for d, sign in pairs) / spread / n ** 2
    unit = {"none": 1.0, "mean": mean, "min": min(reach) / n}[scale]
    return sum(sign * d for d, sign in pairs) / unit / n ** 2


@pytest.mark.parametrize("scale", ["zscore", "mean", "min"])
def test_num_d_squared_distance_is_the_signed_pair_mean(spark, scale):
    rnd = random.Random(4)
    rows = [(rnd.choice("PQR"), rnd.gauss(5, 3), rnd.uniform(0, 40), rnd.choice("xy")) for _ in range(70)]
    df = spark.createDataFrame(rows, "o string, a double, b double, c string")
    got = E.num_d_terms(df, ["o"], ["a", "b"], [("a", "b"), ("b",)], scale)
    for sub, pick in ((("a", "b"), slice(1, 3)), (("b",), slice(2, 3))):
        want = _signed_pair_mean([r[pick] for r in rows], [r[0] for r in rows],
                                 lambda p, q: sum((u - v) ** 2 for u, v in zip(p, q)), scale)
        assert got[("o", sub)] == pytest.approx(want, rel=1e-8, abs=1e-12)


@pytest.mark.parametrize("scale", ["none", "mean", "min"])
def test_num_d_cityblock_is_the_signed_pair_mean(spark, scale):
    rnd = random.Random(8)
    rows = [(rnd.choice("PQR"), rnd.choice("uv"), round(rnd.gauss(5, 3), 1), rnd.uniform(0, 40)) for _ in range(80)] + [("P", "u", None, 1.0)]
    df = spark.createDataFrame(rows, "o string, q string, a double, b double")
    got = E.num_d_cityblock_terms(df, ["o", "q"], ["a", "b"], [("a", "b"), ("b",), ()], scale)
    full = [r for r in rows if r[2] is not None]
    for column, name in enumerate("oq"):
        for sub, pick in ((("a", "b"), slice(2, 4)), (("b",), slice(3, 4))):
            want = _signed_pair_mean([r[pick] for r in full], [r[column] for r in full],
                                     lambda p, q: sum(abs(u - v) for u, v in zip(p, q)), scale)
            assert got[(name, sub)] == pytest.approx(want, rel=1e-8, abs=1e-12)
        assert got[(name, ())] == 0.0
    with pytest.raises(ValueError):
        E.num_d_cityblock_terms(df, ["o"], ["a"], [("a",)], "zscore")
