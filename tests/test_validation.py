import pytest

from equilens.operators.encode import resolve_spec
from equilens.operators.split import subgroup_filter
from equilens.sources.tables import load_table, preview


def _df(spark):
    return spark.createDataFrame([(1, "a", 2.5, 0, "x"), (2, "b", 3.5, 1, "y"), (3, "a", 1.0, 1, "x")],
                                 "id int, cat string, num double, y int, prot string")


def test_resolve_spec_rules(spark):
    df = _df(spark)
    spec = resolve_spec(df, "y", "prot")
    assert spec.protected == ("prot",) and "y" not in spec.features and "prot" not in spec.features
    # user lists win; unknown columns are dropped
    spec2 = resolve_spec(df, "y", ["prot", "missing"], categorical=["cat", "nope"], numerical=["num"])
    assert spec2.protected == ("prot",) and spec2.categorical == ("cat",) and spec2.numerical == ("num",)
    with pytest.raises(ValueError):
        resolve_spec(df, "nope", "prot")
    with pytest.raises(ValueError):
        resolve_spec(df, "y", ["missing"])
    with pytest.raises(ValueError):
        resolve_spec(df, "y", [])


def test_subgroup_filter_errors(spark):
    df = _df(spark)
    assert subgroup_filter(df, {"cat": "a", "prot": "x"}).count() == 2
    with pytest.raises(ValueError):
        subgroup_filter(df, {"unknown": 1})
    with pytest.raises(ValueError):
        subgroup_filter(df, {"cat": "zzz"})


def test_loader_dispatch(spark, tmp_path):
    df = _df(spark)
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert load_table(spark, path=str(tmp_path / "t.parquet")).count() == 3
    assert load_table(spark, name="t", data_dir=str(tmp_path)).count() == 3        # name wins, suffix tried
    assert [r["id"] for r in preview(load_table(spark, name="t", data_dir=str(tmp_path)), ["id"], 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        load_table(spark, path=str(tmp_path / "t.xlsx"))
    with pytest.raises(ValueError):
        load_table(spark, name="absent", data_dir=str(tmp_path))
