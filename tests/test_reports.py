from pyspark.sql import functions as F

from ticketlens.operators import reports as R


def test_null_keys_dropped_and_missing_status(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 0), ("b", 0)], "category string, is_delayed int")
    rows = {r.category: r for r in R.resolution_by_category(df).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].on_time == 0 and rows["a"].delayed_pct == 100.0   # no KeyError when a status is absent
    assert rows["b"].delayed_pct == 0.0


def test_agent_tables(spark):
    data = [("s1", 1)] * 12 + [("s2", 0)] * 11 + [("s3", 1)] * 3
    df = spark.createDataFrame(data, "agent_shift string, is_delayed int").withColumn("unique_id", F.lit("x"))
    perf = R.agent_performance(df).collect()
    assert [r.agent_shift for r in perf] == ["s2", "s1"]                # >= 10 tickets, ascending rate
    bw = R.best_worst_agents(df).collect()
    assert len(bw) == 4                                                  # overlap allowed below 20 groups
    assert {r.agent_shift for r in R.workload_vs_performance(df).collect()} == {"s1", "s2", "s3"}
