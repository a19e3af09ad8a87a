import pytest
from pyspark.sql import functions as F

from equilens.functions.beta import beta_stream, beta_table, residue_table
from equilens.functions.transforms import compose_rebin
from equilens.operators import encode as enc
from equilens.operators.prefix import text_slice_of
from equilens.operators.transform import apply_changes, validity
from equilens.spec import AuditSpec


def test_quartile_duplicate_edges_fall_back_to_equal_width(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 1, 2])], "i int, x double")
    out = [r["x"] for r in enc.bin_quartile(df, "x").orderBy("i").collect()]
    assert out == ["0", "3", "3", "0", "3"]


def test_quartile_bins_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "x double")
    # edges 1, 2.75, 4.5, 6.25, 8
    out = [int(r["b"]) for r in enc.bin_quartile(df, "x", out="b").orderBy("x").collect()]
    assert out == [0, 0, 1, 1, 2, 2, 3, 3]


def test_median_binarise_null_is_false(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert sorted(r["x"] for r in enc.bin_median(df, "x").collect()) == ["False", "False", "False", "True"]


def test_target_rules(spark):
    two = spark.createDataFrame([(1,), (2,), (2,)], "y int")
    assert sorted(r["label_Y"] for r in enc.binarize_target(two, "y").collect()) == [0, 1, 1]
    with pytest.raises(ValueError):
        enc.binarize_target(spark.createDataFrame([("a",), ("b",), ("c",)], "y string"), "y")
    cont = spark.createDataFrame([(None if v is None else float(v),) for v in [1, 2, 3, 4, None]], "y double")
    # null -> median 2.5, then > median
    assert sorted(r["label_Y"] for r in enc.binarize_target(cont, "y").collect()) == [0, 0, 0, 1, 1]


def test_label_encoding_with_null_category(spark):
    df = spark.createDataFrame([("R",), (None,), ("A",), ("R",)], "c string")
    d = {r["label"]: r["code"] for r in enc.encoding_dictionary(df, ["c"]).collect()}
    assert d == {"A": 0, "NaN": 1, "R": 2}
    codes = [r["c"] for r in enc.label_encode(df, ["c"]).collect()]
    assert codes == [2, 1, 0, 2]


def test_chained_rebin():
    assert compose_rebin({3: 1, 1: 0}) == {3: 0, 1: 0}
    assert compose_rebin({1: 0, 3: 1}) == {1: 0, 3: 1}


def test_apply_changes_and_validity(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (-8.0, 2)], "x double, c int")
    spec = AuditSpec("y", ("o",), ("x",), ("c",))
    out = apply_changes(df, spec, {"x": {"beta_O": 0}, "c": {3: 1, 1: 0}}, [3.0, 5.0]).collect()
    assert [r["x"] for r in out] == [1.0, 8.0, -512.0] and [r["c"] for r in out] == [0, 0, 2]
    v = validity(df, spec, [("x", {"beta_O": 0}), ("x", {"beta_O": 5}), ("c", {3: 2, 1: 2})], [3.0, 5.0]).collect()
    assert [r["valid"] for r in v] == [True, False, False]


def test_beta_streams(spark):
    kept = [pow(102, k, 173) for k in range(2, 174)]
    kept = [r for r in kept if r not in (1, 172)]
    table = residue_table(spark, 102, 173).orderBy("k").collect()
    assert [r["a"] for r in table] == kept and [r["b"] for r in table][:-1] == kept[1:]
    assert beta_stream("d4A")[:3] == [3.0, 5.0, 7.0] and beta_stream("d4B")[0] == pytest.approx(1 / 3)
    for m in ("E1", "E6", "E9"):
        assert beta_stream(m) == []
    e2 = beta_stream("E2")
    assert e2 == [x for x in (x / y for x, y in zip(kept, kept[1:])) if 0.5 < x < 2]
    assert beta_stream("E2", order=1) == sorted(e2) and beta_stream("E2", order=-1) == sorted(e2, reverse=True)
    assert beta_table(spark, "E8").columns == ["idx", "beta"]
    with pytest.raises(ValueError):
        beta_stream("E10")


def test_rebin_keeps_the_column_type(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (None, None)], "c int, s string")
    spec = AuditSpec("y", ("o",), (), ("c", "s"))
    out = apply_changes(df, spec, {"c": {"3": "1", "1": "0"}, "s": {"a": "b"}}, [3.0])
    assert out.schema["c"].dataType.simpleString() == "int"
    assert [tuple(r) for r in out.collect()] == [(0, "b"), (0, "b"), (None, None)]


def test_null_and_nan_string_are_one_label(spark):
    df = spark.createDataFrame([(0, "NaN"), (1, None), (2, "A"), (3, "Z"), (4, "é")], "i int, c string")
    d = {r["label"]: r["code"] for r in enc.encoding_dictionary(df, ["c"]).collect()}
    assert d == {"A": 0, "NaN": 1, "Z": 2, "é": 3}
    assert [r["c"] for r in enc.label_encode(df, ["c"]).orderBy("i").collect()] == [1, 1, 0, 2, 3]


def test_labels_sort_by_code_point_beyond_their_first_bytes(spark):
    words = ["prefix-b", "prefix-a", "prefix", "pre", "", "\U0001F600", "z", "Z"]
    df = spark.createDataFrame([(w,) for w in words], "c string")
    d = {r["label"]: r["code"] for r in enc.encoding_dictionary(df, ["c"]).collect()}
    assert [w for w, _ in sorted(d.items(), key=lambda x: x[1])] == sorted(words)


def test_labels_of_one_prefix_are_spread_over_the_slices(spark):
    df = spark.range(20_000).select(F.concat(F.lit("https://example.org/"), F.md5(F.col("id").cast("string"))).alias("c"))
    sizes = [r["count"] for r in df.withColumn("s", text_slice_of(df, F.col("c"), 16)).groupBy("s").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    d = {r["label"]: r["code"] for r in enc.encoding_dictionary(df, ["c"]).collect()}
    assert d == {w: i for i, w in enumerate(sorted(r["c"] for r in df.collect()))}


def test_numeric_labels_with_null(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (None,), (-1.0,)], "c double")
    d = {r["label"]: r["code"] for r in enc.encoding_dictionary(df, ["c"]).collect()}
    assert d == {"-1.0": 0, "9.0": 1, "10.0": 2, "NaN": 3}


def test_target_with_nulls_and_two_values(spark):
    two = spark.createDataFrame([(5.0,), (5.0,), (9.0,), (None,)], "y double")       # the null takes the median 5
    assert sorted(r["label_Y"] for r in enc.binarize_target(two, "y").collect()) == [0, 0, 0, 1]
    mid = spark.createDataFrame([(5.0,), (9.0,), (None,)], "y double")               # the median 7 is a third value
    assert sorted(r["label_Y"] for r in enc.binarize_target(mid, "y").collect()) == [0, 0, 1]


def test_bin_protected_bins_only_numbers(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(1, 9)], "age double, sex string")
    out = enc.bin_protected(df, AuditSpec("y", ("age", "sex")))
    assert sorted(r["age"] for r in out.collect()) == ["0", "0", "1", "1", "2", "2", "3", "3"]
    assert {r["sex"] for r in out.collect()} == {"a", "b"}


def test_constant_column_single_bin_and_unscaled_difference(spark):
    from equilens.operators import epsilon as E
    df = spark.createDataFrame([("A", 2.0, "u"), ("A", 2.0, "v"), ("B", 2.0, "u"), ("B", 2.0, "u")],
                               "o string, x double, c string")
    assert {r["x"] for r in enc.bin_equal_width(df, "x").collect()} == {"0"}
    s = {r["attr"]: r["s"] for r in E.difference_table(df, AuditSpec("y", ("o",), ("x",), ("c",))).collect()}
    assert s["x"] == 0.0                              # equal means; the constant range is left unscaled
    assert s["c"] == pytest.approx((0.5 + 0.5) / 2)   # shares u: 1/2 vs 1, v: 1/2 vs 0


def test_arcsin_outside_domain_is_invalid(spark):
    # M = max|x| < 1 puts |x'| / M outside [-1, 1] for the extreme rows -> NaN -> invalid
    small = spark.createDataFrame([(0.1,), (0.2,), (0.5,)], "x double")
    big = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "x double")
    spec = AuditSpec("y", ("o",), ("x",), ())
    assert validity(small, spec, [("x", {"beta_O": 0})], [3.0], method="arcsin").first()["valid"] is False
    assert validity(big, spec, [("x", {"beta_O": 0})], [3.0], method="arcsin").first()["valid"] is True
