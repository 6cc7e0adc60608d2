"""Dense numbering and running sums without a global window.

A window with no ``partitionBy`` moves every row into one task.  Both helpers
here split the order into contiguous ranges, count (or sum) per range in a
partial aggregate whose result is bounded by the number of ranges, turn those
totals into offsets on the driver, and finish with a window *partitioned by
range*, so each task sorts only its own slice.

* ``number_rows``: ranges are sampled over (md5(key), key, tie-break), so a hot
  key, or a group of identical copies, spreads over many tasks.  The tie-break
  is a hash of the whole row: rows with equal keys but other values have a fixed
  order, and only rows equal in all columns are interchangeable.
* ``running_totals``: ranges come from ``repartitionByRange`` on the order
  column (balanced by sampling), and the range-partitioned rows are written
  to the checkpoint folder once, so the partition ids used for the offsets
  and for the final window are the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.schema import quoted
from ticketlens.session import materialize


def hash_order_key(key_col: str) -> Column:
    return F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")))


def _offsets_frame(spark, rows: list[tuple], key: str, total_cols: list[str]) -> DataFrame:
    """Prefix offsets for bounded per-range totals (one row per range)."""
    acc = [0] * len(total_cols)
    out = []
    for r in rows:
        out.append((r[0], *acc))
        acc = [a + (v or 0) for a, v in zip(acc, r[1:])]
    schema = f"{key} string, " + ", ".join(f"_off_{c} long" for c in total_cols)
    return spark.createDataFrame(out, schema)


def row_tie_break(df: DataFrame) -> Column:
    """Hash of all values of a row and of which are missing."""
    cols = [F.col(quoted(c)) for c in df.columns]
    return F.xxhash64(F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols]), *cols)


def number_rows(df: DataFrame, cond: Column, key_col: str, out_col: str, tie: Column | None = None) -> DataFrame:
    """Rows matching ``cond`` get 0..m-1 in (md5(key), key, tie-break) order; others NULL.

    The numbered rows are written once, so every reader of the result sees the
    same numbers.  ``tie`` is the tie-break where the rows no longer hold all their columns.
    """
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_h"), F.col(key_col).asc_nulls_first(), F.col("_t")]
    picked = (df.where(F.coalesce(cond, F.lit(False))).withColumn("_t", row_tie_break(df) if tie is None else tie)
              .withColumn("_h", hash_order_key(key_col)))
    ranged = materialize(picked.repartitionByRange(n_parts, *order).withColumn("_range", F.spark_partition_id()), "numbering")
    per = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())    # one row per range
    offs = _offsets_frame(spark, [(str(k), n) for k, n in per], "_rk", ["n"])
    offs = offs.withColumn("_range", F.col("_rk").cast("int")).drop("_rk")
    w = Window.partitionBy("_range").orderBy(*order)
    numbered = (ranged.join(F.broadcast(offs), "_range")
                .withColumn(out_col, F.col("_off_n") + F.row_number().over(w) - 1)
                .drop("_h", "_t", "_range", "_off_n"))
    rest = df.where(~F.coalesce(cond, F.lit(False))).withColumn(out_col, F.lit(None).cast("long"))
    return numbered.unionByName(rest)


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], *, descending: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows up to and including this one.

    ``order_col`` must be unique per row (group by it first).  Returns the
    input columns plus the cumulative columns and ``_range`` (range id).
    """
    spark = df.sparkSession
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n_parts, order)
                         .withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()
    rows = sorted((r["_range"], *[r[c] for c in sum_cols]) for r in totals)
    offs = _offsets_frame(spark, [(str(r[0]), *r[1:]) for r in rows], "_rk", sum_cols)
    offs = offs.withColumn("_range", F.col("_rk").cast("int")).drop("_rk")
    w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offs), "_range")
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.sum(c).over(w)).drop(f"_off_{c}")
    return out


def dense_codes(df: DataFrame, group_col: str, value_col: str, out_col: str = "code",
                partitions: int | None = None) -> DataFrame:
    """Code = position of ``value`` among the distinct values of its group, from 0.

    ``df`` must hold distinct (group, value) rows.  Rows are range-partitioned
    on (group, value) and written once, so a group with very many distinct
    values spreads over several tasks; per (range, group) counts give the
    offsets, and a window partitioned by (range, group) numbers each slice.
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n_parts, group_col, value_col)
                         .withColumn("_range", F.spark_partition_id()), "codes")
    counts = sorted((r["_range"], r[group_col], r["n"]) for r in
                    ranged.groupBy("_range", group_col).agg(F.count(F.lit(1)).alias("n")).collect())
    seen: dict = {}
    offs = []
    for rng, grp, n in counts:                 # one row per (range, group): bounded
        offs.append((rng, grp, seen.get(grp, 0)))
        seen[grp] = seen.get(grp, 0) + n
    gtype = df.schema[group_col].dataType.simpleString()
    off_df = spark.createDataFrame(offs, f"_range int, {group_col} {gtype}, _off long")
    w = Window.partitionBy("_range", group_col).orderBy(value_col)
    return (ranged.join(F.broadcast(off_df), ["_range", group_col])
            .withColumn(out_col, (F.col("_off") + F.row_number().over(w) - 1).cast("int"))
            .drop("_range", "_off"))
