"""Feature importance for the accuracy-enhancement step.

a1: plug-in mutual information (nats) between each feature and the class,
categories as they are and numerics in decile bins (exact quantile edges,
duplicates merged); one explode + groupBy(attr, bin, y) pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equilens.operators import permuted
from equilens.operators.models import linear_terms
from equilens.operators.prefix import hash_fraction, quantile_table, slice_count
from equilens.operators.profile import equal_width_bin
from equilens.operators.sizing import written

STACKED_ROWS = 5_000_000      # rows times permutations that are stacked at once, about


def mutual_information(df: DataFrame, label: str, numerical, categorical, bins: int = 10) -> DataFrame:
    items = []
    qt = quantile_table(df, list(numerical), [i / bins for i in range(bins + 1)]) if numerical else {}
    for c in numerical:
        edges = sorted(set(x for x in qt[c] if x is not None))
        b = equal_width_bin(F.col(c).cast("double"), edges) if len(edges) > 2 else F.lit(0)
        items.append(F.struct(F.lit(c).alias("attr"), F.when(F.col(c).isNotNull(), b.cast("string")).alias("x")))
    for c in categorical:
        items.append(F.struct(F.lit(c).alias("attr"), F.col(c).cast("string").alias("x")))
    j = (df.select(F.col(label).alias("y"), F.explode(F.array(*items)).alias("i")).select("y", "i.*")
           .where(F.col("x").isNotNull() & F.col("y").isNotNull())
           .groupBy("attr", "x", "y").agg(F.count(F.lit(1)).alias("nxy")))
    wa = Window.partitionBy("attr")
    wx = Window.partitionBy("attr", "x")
    wy = Window.partitionBy("attr", "y")
    t = j.select("attr", "nxy", F.sum("nxy").over(wa).alias("n"), F.sum("nxy").over(wx).alias("nx"),
                 F.sum("nxy").over(wy).alias("ny"))
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return t.groupBy("attr").agg(F.sum(term).alias("importance"))


def pick_lowest(imp: DataFrame, exclude=()) -> DataFrame:
    """The least important attribute not in ``exclude`` (dropped or skipped); ties by name."""
    e = imp.where(~F.col("attr").isin(list(exclude))) if exclude else imp
    b = e.agg(F.min(F.struct("importance", "attr")).alias("b"))
    return b.select("b.attr", "b.importance").where(F.col("attr").isNotNull())


def permutation_importance(model, test: DataFrame, feats, key_cols, label: str = "label_Y", repeats: int = 5,
                           seed: int = 0) -> DataFrame:
    """Mean accuracy drop when one feature is permuted (``repeats`` permutations each).

    A permutation is a cyclic shift along a content-hash order of the rows: every row takes the
    value of the next hash.  Rows with identical content share a hash and move together.  A
    logistic regression is scored from packed rows (:mod:`permuted`), other models by
    ``model.transform`` of the stacked rows of some permutations at a time.
    """
    feats, key_cols = list(feats), list(key_cols)
    content = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols + feats])
    terms = linear_terms(model)
    if terms is not None and {*feats} <= {*terms[1]}:
        got = permuted.accuracies(terms, test, feats, content, label, repeats, seed)
        base_acc, found = got or (None, {})
        rows = [(f, None if None in (base_acc, *accs) else base_acc - sum(accs) / len(accs)) for f, accs in found.items() if accs]
        return test.sparkSession.createDataFrame(rows, "attr string, importance double")
    # every row becomes one for each variant: spread over all tasks first, however few files hold them
    tasks = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    test = written(test.repartition(tasks, *test.columns), "tests")
    base_pred = model.transform(test)
    base_acc, n = base_pred.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")), F.count(F.lit(1))).first()
    variants = [(f, r) for f in feats for r in range(repeats)]
    step = max(1, STACKED_ROWS // max(n, 1))
    parts = []
    for a in range(0, len(variants), step):
        acc = _stacked_accuracies(model, test, feats, content, variants[a:a + step], label, seed)
        # the last pass stays a plan, earlier ones give their few rows and free their files
        parts.append(acc if a + step >= len(variants) else test.sparkSession.createDataFrame(acc.collect(), "feat string, rep int, acc double"))
        if a + step < len(variants):
            del acc
            permuted.free_shuffles(test.sparkSession)
    acc = reduce(DataFrame.unionByName, parts)
    return acc.groupBy(F.col("feat").alias("attr")).agg((F.lit(base_acc) - F.avg("acc")).alias("importance"))


def _stacked_accuracies(model, test: DataFrame, feats: list, content, variants: list, label: str, seed: int) -> DataFrame:
    """``(feat, rep, acc)`` of the permutations in ``variants``, whose rows are stacked and scored by one ``model.transform``.

    The hash is uniform, so its leading bits cut each variant into even slices; a row is exchanged
    once, to its slice, and the last hash of a slice takes the first value of the next filled one.
    """
    variants = F.explode(F.array(*[F.struct(F.lit(f).alias("feat"), F.lit(r).alias("rep")) for f, r in variants]))
    stacked = test.select("*", content.alias("_c"), variants.alias("vr")).select("*", "vr.feat", "vr.rep").drop("vr")
    h = F.md5(F.concat_ws(":", "_c", F.col("feat"), F.col("rep").cast("string"), F.lit(str(seed))))
    val = F.lit(None).cast("string")
    for f in feats:
        val = F.when(F.col("feat") == f, F.col(f).cast("string")).otherwise(val)
    slices = slice_count(test)
    stacked = stacked.withColumn("_h", h).withColumn("_v", val).drop("_c") \
        .withColumn("_s", F.floor(hash_fraction(F.col("_h")) * (slices / 2.0 ** 32)).cast("int"))
    # first value of each slice: the least leading 60 bits (a hash aggregate), then the least hash among these few
    part = ["feat", "rep", "_s"]
    led = stacked.select(*part, F.conv(F.substring("_h", 1, 15), 16, 10).cast("long").alias("_k"), "_h", "_v")
    least = written(led.groupBy(*part).agg(F.min("_k").alias("_k")), "least")
    first = led.join(F.broadcast(least), [*part, "_k"]).groupBy(*part).agg(F.min(F.struct("_h", "_v")).alias("_f"))
    first = written(first.select(*part, F.struct("_f._v").alias("_f")), "first")
    all_slices = Window.partitionBy("feat", "rep").orderBy("_s")
    wrap = F.first("_f").over(all_slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = first.select(*part, F.coalesce(F.lead("_f").over(all_slices), wrap).alias("_after"))
    inside, block = Window.partitionBy(*part).orderBy("_h"), Window.partitionBy(*part, "_h")
    perm = stacked.withColumn("_nh", F.lead("_h").over(inside)).withColumn("_nx", F.lead(F.struct("_v")).over(inside)) \
        .withColumn("_nx", F.max(F.when(F.col("_nh") != F.col("_h"), F.col("_nx"))).over(block)) \
        .join(F.broadcast(after), part).withColumn("_nv", F.coalesce("_nx", "_after")["_v"])
    types = dict((f.name, f.dataType) for f in test.schema.fields)
    for f in feats:
        perm = perm.withColumn(f, F.when(F.col("feat") == f, F.col("_nv").cast(types[f])).otherwise(F.col(f)))
    acc = (model.transform(perm.drop("_h", "_v", "_nv", "_s", "_nh", "_nx", "_after"))
           .groupBy("feat", "rep").agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("acc")))
    return acc


def fold_moments(df: DataFrame, cols, label: str, folds: int, seed: int = 0):
    """Centres of all rows, and per fold ``(n, sums, products)`` of the centred columns, the label last.

    Two aggregates, whatever the number of penalties: (p + 2)(p + 3)/2 sums for each fold reach the
    driver.  A row's fold is a hash of its values, so it is the same wherever the row is computed.
    """
    import numpy as np
    cols = [*cols, label]
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    p = len(cols)
    first = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    centre = [first[f"m{i}"] or 0.0 for i in range(p)]
    fold = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(folds)).alias("fold")
    z = rows.select(fold, *[(F.col(f"x{i}") - F.lit(centre[i])).alias(f"x{i}") for i in range(p)])
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(p)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    out = []
    for r in sorted(z.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect(), key=lambda r: r["fold"]):
        g = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                g[i, j] = g[j, i] = r[f"p{i}_{j}"]
        out.append((r["n"], np.array([r[f"s{i}"] for i in range(p)]), g))
    return np.array(centre), out


def _add_moments(parts):
    return tuple(sum(x) for x in zip(*parts))


def _covariances(moments):
    """Sums of products about the rows' own means: of the features, and of the features with the label."""
    n, s, g = moments
    c = g - s[:, None] * s[None, :] / max(n, 1)
    return c[:-1, :-1], c[:-1, -1]


def _descend(gram, cross, limit: float, w, tolerance: float = 1e-10, sweeps: int = 5000):
    """Coordinate descent of ``w'Gw/2 - c'w + limit * |w|_1`` from a warm start."""
    import numpy as np
    w, scale = w.copy(), np.sqrt(np.maximum(np.diag(gram), 0.0))
    pull = cross - gram @ w
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            own = pull[j] + gram[j, j] * w[j]
            new = np.sign(own) * max(abs(own) - limit, 0.0) / gram[j, j]
            if new != w[j]:
                pull -= gram[:, j] * (new - w[j])
                moved, w[j] = max(moved, abs(new - w[j]) * scale[j]), new
        if moved <= tolerance * max(np.abs(w * scale).max(), 1e-300):
            break
    return w


def lasso_path(centre, parts, n_penalties: int = 100, span: float = 1e-3) -> dict:
    """Penalties, their mean held-out squared error over the folds, the chosen one and its coefficients.

    The penalties fall geometrically from the least one that sets all coefficients to 0 to ``span``
    of it, and every path starts where the penalty before ended.  Nothing here touches rows.
    """
    import numpy as np
    if not parts:
        return {"penalties": [], "errors": [], "penalty": 0.0, "coefficients": np.zeros(len(centre) - 1)}
    whole = _add_moments(parts)
    gram, cross = _covariances(whole)
    top = np.abs(cross).max(initial=0.0) / max(whole[0], 1)
    zero = np.zeros(len(cross))
    if top <= 0:
        return {"penalties": [], "errors": [], "penalty": 0.0, "coefficients": zero}
    penalties = top * np.geomspace(1.0, span, n_penalties)

    def path(moments):
        g, c = _covariances(moments)
        w, out = zero, []
        for penalty in penalties:
            w = _descend(g, c, penalty * moments[0], w)
            out.append(w)
        return out

    errors = np.zeros((len(parts), n_penalties))
    for k, held in enumerate(parts):
        rest = [m for i, m in enumerate(parts) if i != k]
        if not rest:
            rest = [held]
        train = _add_moments(rest)
        mean = train[1] / train[0]
        for a, w in enumerate(path(train)):
            v = np.append(-w, 1.0)                    # the residual is v'z minus its mean in training
            b = v @ mean
            errors[k, a] = (v @ held[2] @ v - 2 * b * (v @ held[1]) + held[0] * b * b) / held[0]
    mean_error = errors.mean(axis=0)
    best = int(mean_error.argmin())
    return {"penalties": penalties, "errors": mean_error, "penalty": penalties[best], "coefficients": path(whole)[best]}


def lasso_importance(train: DataFrame, numerical, categorical, label: str = "label_Y", folds: int = 5,
                     seed: int = 0, n_penalties: int = 100) -> DataFrame:
    """|coefficient| of an L1 linear regression whose penalty, one of a hundred, is picked by k-fold
    cross-validation; categoricals enter as their sorted-label codes (one coefficient per attribute).

    The rows are read for the moments of each fold only; paths and errors follow from these.  Rows
    with a null number are left out; a column that is constant has importance 0.
    """
    from pyspark.ml.feature import StringIndexer
    num, cat = list(numerical), list(categorical)
    codes = [f"{c}__code" for c in cat]
    rows = train
    if cat:
        rows = StringIndexer(inputCols=cat, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep").fit(train).transform(train)
    found = lasso_path(*fold_moments(rows, [*num, *codes], label, folds, seed), n_penalties)["coefficients"]
    return train.sparkSession.createDataFrame([(c, float(abs(w))) for c, w in zip([*num, *cat], found)], "attr string, importance double")
