import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 39 and set(df.columns) == {"metric", "protected", "value"}


def test_every_query_has_an_oracle_or_is_documented():
    from equilens.oracle import ORACLE
    from equilens.registry import all_queries
    assert set(entry.oracle_sql()) <= set(entry.queries())
    qs, sql = all_queries(), ORACLE       # the training-data queries have their own tests
    rows_only = set(qs) - set(sql)
    allowed = {n for n in qs if n.startswith(("score_", "run_", "bm_iteration", "evaluate_", "metric_series",
                                               "before_after", "permutation_", "subgroup_report", "lasso_",
                                               "knn_", "adaboost_", "distance_mahalanobis", "epsilon_num_d"))}
    assert rows_only <= allowed, rows_only - allowed
