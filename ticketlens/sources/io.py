"""Sources and sinks.

* S1 ``read_tickets_csv``: header CSV read as text, export names mapped to
  snake_case; the named numeric columns are converted (bad text -> NULL), columns
  that the export doesn't name get the type that reads all their texts
  (``types.infer_types``, one more pass over these columns).  Timestamps stay text
  for the parse in ``clean.clean_data``, whose patterns are inferred or given.
* S2/S3 ``load_project_data``: processed table if present, else the raw
  export, else nothing; optional comparison table and run record; models.
* S4-S6 writers; S7/S8 model persistence through ``pyspark.ml`` writers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import schema as S
from ticketlens.sources.types import typed

# --- fixed values: the texts that a CSV reader of the pandas kind takes as missing ---
NULL_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMERIC_TYPES = {"item_price": "double", "connected_handling_time": "double", "csat_score": "bigint"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL, the one missing value of all later steps."""
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    col = lambda c: F.col(S.quoted(c))
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in real else col(c) for c in df.columns])


def read_tickets_csv(spark: SparkSession, path: str, rename: dict[str, str] = S.RAW_TO_SNAKE,
                     null_markers: list[str] = NULL_MARKERS, infer: bool = True) -> DataFrame:
    """Read a ticket export; ``null_markers`` become NULL.

    The columns that ``rename`` knows keep their types at any content.  All others
    pass through under their own names, in the type that fits all their texts, or as
    text with ``infer=False``.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True) \
        .option("escape", '"').csv(path)
    out = raw.select(*[F.when(~F.col(S.quoted(c)).isin(null_markers), F.col(S.quoted(c))).alias(rename.get(c, c)) for c in raw.columns])
    casts = {c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in NUMERIC_TYPES.items() if c in out.columns}
    out = out.withColumns(casts) if casts else out
    extra = [c for c in out.columns if c not in set(rename.values())]
    return typed(out, extra) if infer and extra else out


def write_tickets_csv(df: DataFrame, path: str, rename: dict[str, str] = S.RAW_TO_SNAKE) -> str:
    """Write a table with the export's column names (the inverse of S1)."""
    back = {v: k for k, v in rename.items()}
    out = df.select(*[F.col(S.quoted(c)).cast("string").alias(back.get(c, c)) for c in df.columns])
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a processed table (parquet by default; ``fmt='csv'`` with header)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def write_comparison(df: DataFrame, path: str) -> str:
    """The model comparison table (a few rows, model and metrics) as one header CSV file."""
    df.drop("position", "is_best").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def run_record(spark: SparkSession, *, data_shape: tuple[int, int], cleaned_shape: tuple[int, int],
               total_features: int, target_column: str, best_model: str, best_model_accuracy: float,
               execution_time_seconds: float, data_file: str = "", project_name: str = "",
               execution_timestamp: str = "") -> DataFrame:
    """One-row run record; the shapes are ``array<bigint>``."""
    schema = T.StructType([
        T.StructField("project_name", T.StringType()), T.StructField("execution_timestamp", T.StringType()),
        T.StructField("data_file", T.StringType()),
        T.StructField("data_shape", T.ArrayType(T.LongType())),
        T.StructField("cleaned_data_shape", T.ArrayType(T.LongType())),
        T.StructField("total_features", T.LongType()), T.StructField("target_column", T.StringType()),
        T.StructField("best_model", T.StringType()), T.StructField("best_model_accuracy", T.DoubleType()),
        T.StructField("execution_time_seconds", T.DoubleType())])
    row = (project_name, execution_timestamp, data_file, list(data_shape), list(cleaned_shape), total_features,
           target_column, best_model, float(best_model_accuracy), round(float(execution_time_seconds), 2))
    return spark.createDataFrame([row], schema)


def write_run_record(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def _try(read):
    try:
        return read()
    except AnalysisException:
        return None


@dataclass
class ProjectData:
    df: DataFrame | None
    model_comparison: DataFrame | None
    metadata: dict | None
    models: dict | None
    unreadable_models: list | None = None


def load_project_data(spark: SparkSession, processed_path: str, raw_path: str | None = None,
                      comparison_path: str | None = None, metadata_path: str | None = None,
                      models_dir: str | None = None) -> ProjectData:
    """Load whatever earlier runs left behind; missing parts are None."""
    df = _try(lambda: nan_to_null(spark.read.parquet(processed_path)))
    if df is None and raw_path:
        df = _try(lambda: read_tickets_csv(spark, raw_path))
    comp = _try(lambda: spark.read.option("header", True).option("inferSchema", True).csv(comparison_path)) \
        if comparison_path else None
    meta = None
    if metadata_path:
        rec = _try(lambda: spark.read.option("multiLine", True).json(metadata_path))
        if rec is not None:
            first = rec.first()      # a single run record
            meta = json.loads(json.dumps(first.asDict(recursive=True))) if first else None
    skipped: list = []
    models = load_models(spark, models_dir, skipped=skipped) if models_dir else None
    return ProjectData(df, comp, meta, models, skipped)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def load_models(spark: SparkSession, models_dir: str, reader: type[MLReadable] = PipelineModel,
                skipped: list | None = None) -> dict:
    """Every model saved under ``models_dir`` by name.

    A folder that isn't a readable model is skipped, as in the reference; its
    name and error are appended to ``skipped``.
    """
    fs, p = _fs(spark, models_dir)
    if not fs.exists(p):
        return {}
    out = {}
    for st in fs.listStatus(p):
        if not st.isDirectory():
            continue
        name = st.getPath().getName()
        try:
            out[name] = reader.load(st.getPath().toString())
        except (Py4JJavaError, PySparkException) as e:
            if skipped is not None:
                skipped.append((name, str(e)[:200]))
    return out
