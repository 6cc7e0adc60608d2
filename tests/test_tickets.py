from pyspark.sql import functions as F

from conftest import SF_SMALL
from ticketlens.sources.tickets import tickets


def _rows(df):
    return sorted(tuple(r) for r in df.select("unique_id", "customer_remarks", "order_id").collect())


def test_salted_remark_join_same_rows_with_shuffle_join(spark):
    broadcast = _rows(tickets(spark, SF_SMALL))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = tickets(spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffled = _rows(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan
    assert shuffled == broadcast
    # a third of the events (event_id % 3 == 0) carry no remark
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    no_key = events.where(F.col("event_id") % 3 == 0).count()
    dup_no_key = events.where((F.col("event_id") % 3 == 0) & (F.col("event_id") % 97 == 0)).count()
    assert sum(1 for r in shuffled if r[1] is None) == no_key + dup_no_key
