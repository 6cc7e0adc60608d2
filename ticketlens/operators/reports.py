"""Report tables behind the reference's charts.

Every table is one grouped aggregate (partial aggregation map-side, so a hot
key costs one row per map task) plus, where the chart shows a top-k, an
``orderBy(...).limit(k)`` that Spark runs as a per-partition top-k
(TakeOrderedAndProject).  Missing group keys are dropped, as pandas
``groupby`` / ``value_counts`` / ``crosstab`` do.  Ties are broken by the key
so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import schema as S
from ticketlens.functions import status_label


def volume_by(df: DataFrame, key_expr, key_name: str) -> DataFrame:
    """Ticket count per key (A1-A4)."""
    return (df.where(key_expr.isNotNull()).groupBy(key_expr.alias(key_name))
            .agg(F.count(F.lit(1)).alias("ticket_count")))


def delay_rate_by(df: DataFrame, key_expr, key_name: str, target_col: str = S.TARGET) -> DataFrame:
    """Mean of the 0/1 target per key."""
    return (df.where(key_expr.isNotNull()).groupBy(key_expr.alias(key_name))
            .agg(F.avg(target_col).alias("delayed_rate")))


def daily_volume(df: DataFrame, col: str = S.REPORTED) -> DataFrame:
    return volume_by(df, F.to_date(col), "date").orderBy("date")


def hourly_volume(df: DataFrame, col: str = S.REPORTED) -> DataFrame:
    return volume_by(df, F.hour(col), "hour").orderBy("hour")


def weekday_volume(df: DataFrame, col: str = S.REPORTED) -> DataFrame:
    return volume_by(df, F.weekday(col), "day_of_week").orderBy("day_of_week")


def monthly_volume(df: DataFrame, col: str = S.REPORTED) -> DataFrame:
    return volume_by(df, F.month(col), "month").orderBy("month")


def daily_delay_rate(df: DataFrame, col: str = S.REPORTED, target_col: str = S.TARGET) -> DataFrame:
    return delay_rate_by(df, F.to_date(col), "date", target_col).orderBy("date")


def hourly_delay_rate(df: DataFrame, col: str = S.REPORTED, target_col: str = S.TARGET) -> DataFrame:
    return delay_rate_by(df, F.hour(col), "hour", target_col).orderBy("hour")


def weekday_delay_rate(df: DataFrame, col: str = S.REPORTED, target_col: str = S.TARGET) -> DataFrame:
    return delay_rate_by(df, F.weekday(col), "day_of_week", target_col).orderBy("day_of_week")


def status_by(df: DataFrame, key: str, target_col: str = S.TARGET) -> DataFrame:
    """On-time / delayed counts per key (a 2-column crosstab, missing status -> 0)."""
    t = F.col(target_col)
    return (df.where(F.col(key).isNotNull() & t.isNotNull()).groupBy(key)
            .agg(F.count_if(t == 0).alias("on_time"), F.count_if(t == 1).alias("delayed")))


def resolution_by_category(df: DataFrame, category_col: str = "category",
                           target_col: str = S.TARGET, top: int = 10) -> DataFrame:
    """Crosstab with delayed_pct, highest percentage first, top 10."""
    ct = status_by(df, category_col, target_col)
    pct = F.try_divide(F.col("delayed") * 100.0, F.col("on_time") + F.col("delayed"))
    return (ct.withColumn("delayed_pct", pct)
            .orderBy(F.col("delayed_pct").desc_nulls_last(), F.col(category_col)).limit(top))


def top_values(df: DataFrame, col: str, top: int = 10, count_name: str = "count") -> DataFrame:
    """The ``top`` most frequent non-null values of one column."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
            .orderBy(F.col(count_name).desc(), F.col(col)).limit(top))


def top_values_many(df: DataFrame, cols: list[str], top: int = 5) -> DataFrame:
    """Top values of several columns in one shuffle.

    (column_name, value, count, rank); the per-column rank is a window over the
    already-aggregated (column, value) rows, partitioned by column.
    """
    from ticketlens.operators.order_stats import value_counts
    vc = value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value"))
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def agent_workload(df: DataFrame, agent_col: str = "agent_shift", top: int = 15) -> DataFrame:
    """A10: tickets per agent group, busiest first."""
    return top_values(df, agent_col, top, "ticket_count")


def agent_performance(df: DataFrame, agent_col: str = "agent_shift", target_col: str = S.TARGET,
                      min_tickets: int = 10) -> DataFrame:
    """Delay rate and ticket count per agent group, at least ``min_tickets``."""
    return (df.where(F.col(agent_col).isNotNull()).groupBy(agent_col)
            .agg(F.avg(target_col).alias("delayed_rate"), F.count(target_col).alias("ticket_count"))
            .where(F.col("ticket_count") >= min_tickets)
            .orderBy("delayed_rate", agent_col))


def best_worst_agents(df: DataFrame, agent_col: str = "agent_shift", target_col: str = S.TARGET,
                      k: int = 10, min_tickets: int = 10) -> DataFrame:
    """Lowest-k and highest-k delay rates, tagged; overlap allowed."""
    perf = agent_performance(df, agent_col, target_col, min_tickets)
    best = perf.orderBy("delayed_rate", agent_col).limit(k).withColumn("side", F.lit("best"))
    worst = (perf.orderBy(F.col("delayed_rate").desc(), F.col(agent_col).desc()).limit(k)
             .withColumn("side", F.lit("worst")))
    return best.unionByName(worst)


def workload_vs_performance(df: DataFrame, agent_col: str = "agent_shift",
                            target_col: str = S.TARGET, id_col: str = S.UNIQUE_ID) -> DataFrame:
    """Delay rate and non-null id count per agent group, no minimum."""
    return (df.where(F.col(agent_col).isNotNull()).groupBy(agent_col)
            .agg(F.avg(target_col).alias("delayed_rate"), F.count(id_col).alias("ticket_count")))


def status_counts(df: DataFrame, target_col: str = S.TARGET) -> DataFrame:
    """Ticket count per status label."""
    lab = status_label(target_col)
    return (df.where(lab.isNotNull()).groupBy(lab.alias("status"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "status"))


def status_by_top_categories(df: DataFrame, category_col: str = "category",
                             target_col: str = S.TARGET, top: int = 10) -> DataFrame:
    """Delayed / On-time counts for the ``top`` busiest categories.

    The top list is at most ``top`` rows, so the semi join broadcasts it.
    """
    busiest = top_values(df, category_col, top).select(category_col)
    ct = status_by(df, category_col, target_col)
    return (ct.join(F.broadcast(busiest), category_col, "left_semi")
            .select(category_col, F.col("delayed").alias("Delayed"), F.col("on_time").alias("On_time")))


def top_delay_rate_categories(df: DataFrame, category_col: str = "category",
                              target_col: str = S.TARGET, top: int = 10) -> DataFrame:
    """Categories with the highest delay rate."""
    return (delay_rate_by(df, F.col(category_col), category_col, target_col)
            .orderBy(F.col("delayed_rate").desc(), F.col(category_col)).limit(top))


def response_summary(df: DataFrame, target_col: str = S.TARGET) -> DataFrame:
    """Mean response time, delayed count and percent (one row)."""
    aggs = []
    if "response_time_minutes" in df.columns:
        aggs.append(F.avg("response_time_minutes").alias("mean_response_time"))
    if target_col in df.columns:
        aggs += [F.sum(target_col).cast("long").alias("delayed_count"),
                 (F.avg(target_col) * 100).alias("delayed_pct")]
    return df.agg(*aggs)
