"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ticketlens") -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    AQE stays on so shuffle partition counts and skewed joins are re-planned at
    run time; the session zone is pinned to UTC so timestamp arithmetic matches
    the naive timestamps of the input.
    """
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only for local runs.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; a
    machine-local temporary folder would be lost with its executor, so it is
    only created when the master is local (tests, single-node runs).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="ticketlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "table", partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table under the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor only loses blocks
    that are already on shared storage) but keeps the data columnar, so later
    passes that touch a few columns prune the rest and push filters down.
    Used after the few wide steps whose output several later jobs read.
    """
    path = scratch_dir(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    _written[id(out)] = (out, path)
    return out


#: tables of ``materialize`` that haven't been released, by the identity of their frame
_written: dict[int, tuple[DataFrame, str]] = {}


def release(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``materialize`` returned; nothing may read them afterwards."""
    for df in frames:
        _, path = _written.pop(id(df), (None, None))
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release_all() -> None:
    """Delete every table that ``materialize`` wrote in this process and that is still there."""
    if SparkContext._active_spark_context is not None:
        release(*[df for df, _ in list(_written.values())])


atexit.register(release_all)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


ROWS_PER_TRAINING_TASK = 20_000


def training_partitions(rows: int) -> int:
    """Partitions of an iteratively scanned training table: they grow with its rows, whatever the cluster.

    Bagging seeds are per partition, so a count that followed the cores would
    make a forest depend on the cluster it was fitted on.
    """
    return max(4, -(-rows // ROWS_PER_TRAINING_TASK))


def checkpoint_by_key(df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """Checkpoint a training table dealt by the hash of ``key`` and sorted within its parts.

    The parts and the order of their rows then depend on the data alone; a
    checkpoint keeps them, where a Parquet scan would pack files by cores.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    ensure_checkpoint_dir(df.sparkSession)
    rest = [F.col(c) for c in df.columns if c not in (key, features)]
    return (df.repartition(training_partitions(df.count()), key)
            .sortWithinPartitions(key, *rest, vector_to_array(features)).checkpoint())
