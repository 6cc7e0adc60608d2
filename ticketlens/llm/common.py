"""Shared helpers: written tables with clean-up, global numbering, word rules."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens.session import ensure_checkpoint_dir

#: Java regular expression of one word of the contracts: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


class Scratch:
    """Tables written under the session's ``spark.checkpoint.dir``.

    ``write`` cuts the lineage: a lost executor loses nothing that a later
    stage needs.  ``drop`` deletes tables that only finished jobs read; what is
    left when Python exits is deleted then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _bases.append(self.base)
        self.paths: dict[int, str] = {}
        self._frames: list[DataFrame] = []

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._frames.append(out)              # an id stays taken as long as its path is known
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                delete(self.spark.sparkContext, path)

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete every table of this scratch space but those of ``frames``; nothing may read the others afterwards."""
        kept = {id(df) for df in frames}
        for key in [k for k in self.paths if k not in kept]:
            delete(self.spark.sparkContext, self.paths.pop(key))


def delete(sc: SparkContext, path: str) -> None:
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _delete_all() -> None:
    if SparkContext._active_spark_context is not None:
        while _bases:
            delete(SparkContext._active_spark_context, _bases.pop())


_bases: list[str] = []
atexit.register(_delete_all)


def prefix_sums(scratch: Scratch, df: DataFrame, order: list, weight: Column, out: str) -> DataFrame:
    """``df`` with ``out`` = sum of ``weight`` over all rows before it in ``order``.

    Rows are range-partitioned by sampling and written; each partition then
    adds the total of the partitions before it (one row per partition) to its
    own running sum, so no task sees more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = scratch.write(df.repartitionByRange(n, *order)
                         .withColumn("_part", F.spark_partition_id())
                         .withColumn("_weight", weight.cast("long")), f"{out}-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (part.groupBy("_part").agg(F.sum("_weight").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    run = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (part.join(F.broadcast(offsets), "_part")      # one row per shuffle partition
            .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_weight").over(run), F.lit(0)))
            .drop("_part", "_offset", "_weight"))


def pack(docs: DataFrame, **cols: Column) -> DataFrame:
    """The whole input row as one struct ``_row`` beside named columns, so that no input name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
                       *[c.alias(k) for k, c in cols.items()])


def unpack(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """Input columns again, followed by ``added``; an input column named like an added one gives way."""
    keep = [F.col("_row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*keep, *added)
