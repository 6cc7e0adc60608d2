"""Data-quality profile (Q1-Q8).

Each report is a single aggregate over the table (or one distinct pass for
duplicates), reshaped with ``unpivot`` into one row per column.  Scalar
totals enter other plans as scalar subqueries, not as collected Python
values, so every report stays one lazily planned DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import schema as S
from ticketlens.operators.order_stats import exact_quantiles
from ticketlens.operators.reports import top_values_many


def is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating-point column (pandas counts both)."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(S.quoted(c)).isNull() | F.isnan(F.col(S.quoted(c)))
    return F.col(S.quoted(c)).isNull()


def missing_report(df: DataFrame) -> DataFrame:
    """Q1: (column_name, missing_values, percentage) for columns with nulls."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("missing_values"))
        for i, c in enumerate(cols)])).alias("kv"))
    return (long.select("kv.column_name", "kv.missing_values",
                        (F.col("kv.missing_values") * 100.0 / F.col("_n")).alias("percentage"))
            .where(F.col("missing_values") > 0))


def row_hashes(df: DataFrame) -> DataFrame:
    """Two 64-bit hashes of every row and of which values it lacks: what a duplicate count shuffles instead of the row."""
    h1, h2 = row_digest(df)
    return df.select(h1.alias("h1"), h2.alias("h2"))


def row_digest(df: DataFrame) -> tuple[Column, Column]:
    cols = [F.col(S.quoted(c)) for c in df.columns]
    lacks = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])    # hashes pass over NULLs
    return F.xxhash64(lacks, *cols), F.xxhash64(F.lit(1), lacks, *cols)


def _distinct_rows(df: DataFrame):
    return row_hashes(df).distinct().select(F.count(F.lit(1))).scalar()


def duplicate_report(df: DataFrame) -> DataFrame:
    """Q2: rows beyond the first copy of each full-row duplicate, and percent."""
    d = _distinct_rows(df)
    return df.agg(F.count(F.lit(1)).alias("_n")).select(
        (F.col("_n") - d).cast("long").alias("duplicates"),
        ((F.col("_n") - d) * 100.0 / F.col("_n")).alias("duplicate_percent"))


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q3: count, mean, sample std, min, exact quartiles, max per numeric column."""
    cols = cols or S.numeric_columns(df)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(S.quoted(c)).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    wide = df.agg(*aggs)

    def lit_d(v):
        return F.lit(v).cast("double")

    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                 F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                 F.col(f"min{i}").alias("min"), lit_d(q[c][0]).alias("p25"),
                 lit_d(q[c][1]).alias("p50"), lit_d(q[c][2]).alias("p75"),
                 F.col(f"max{i}").alias("max"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def top_values_report(df: DataFrame, n_cols: int = 5, top: int = 5) -> DataFrame:
    """Q4: top value counts of the first ``n_cols`` text columns."""
    return top_values_many(df, S.string_columns(df)[:n_cols], top)


def quality_summary(df: DataFrame) -> DataFrame:
    """Q5-Q7: rows, columns, duplicates (count, percent), missing cells."""
    d = _distinct_rows(df)
    total_missing = sum((F.count_if(is_missing(df, c)) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), total_missing.cast("long").alias("total_missing")
                  ).select("total_rows", F.lit(len(df.columns)).alias("total_columns"),
                           (F.col("total_rows") - d).cast("long").alias("duplicates"),
                           ((F.col("total_rows") - d) * 100.0 / F.col("total_rows")).alias("duplicate_percent"),
                           "total_missing")


def quality_record(df: DataFrame) -> DataFrame:
    """Q5: the summary row with the maps ``missing_values`` and ``missing_percent`` over all columns."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    entries = lambda v: F.map_from_entries(F.array(*[
        F.struct(F.lit(c).alias("k"), v(F.col(f"_m{i}")).alias("v")) for i, c in enumerate(df.columns)]))
    d = _distinct_rows(df)
    return wide.select(F.col("_n").alias("total_rows"), F.lit(len(df.columns)).alias("total_columns"),
                       entries(lambda m: m).alias("missing_values"), entries(lambda m: m * 100.0 / F.col("_n")).alias("missing_percent"),
                       (F.col("_n") - d).cast("long").alias("duplicates"),
                       ((F.col("_n") - d) * 100.0 / F.col("_n")).alias("duplicate_percent"))


def head(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """Q6: first rows by a deterministic order (top-k, not a sample)."""
    order = order or [c for c in (S.UNIQUE_ID, S.REMARKS) if c in df.columns] or df.columns[:1]
    return df.orderBy(*[F.col(S.quoted(c)) for c in order]).limit(n)


def target_distribution(df: DataFrame, target_col: str = S.TARGET) -> DataFrame:
    """Q8: count and share per target value."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(target_col).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("share", F.col("count") / total))


CLEAN_STAT_COLUMNS = (["mean_response_time", "duplicates_removed"]
                      + [f"{c}_filled" for c in S.MODE_FILL_COLS] + ["order_id_generated"]
                      + [f"{c}_filled" for c in S.MEDIAN_FILL_COLS + S.UNKNOWN_FILL_COLS]
                      + ["order_date_time_filled", "remaining_missing"])


def clean_stats_frame(spark: SparkSession, stats: dict) -> DataFrame:
    """The cleaning record as a one-row frame (absent counts are 0)."""
    fields = ["mean_response_time double"] + [f"{c} long" for c in CLEAN_STAT_COLUMNS[1:]]
    row = [stats.get("mean_response_time")] + [int(stats.get(c, 0)) for c in CLEAN_STAT_COLUMNS[1:]]
    return spark.createDataFrame([tuple(row)], ", ".join(fields))
