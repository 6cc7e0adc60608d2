import __spark_entry__ as entry


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "on_time", "delayed", "delayed_pct"]
    assert df.count() >= 0
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    no_sql = {k for k in set(q) - set(sql) if not k.startswith("op") and k != "pipeline"}
    assert no_sql == {"delay_model_comparison", "delay_model_comparison_long", "delay_feature_importance",
                      "csat_model_ranking", "delay_cross_validation",
                      "delay_grid_search", "delay_forest_search"}
