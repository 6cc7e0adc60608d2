"""The type of every text column of an export, from all its texts.

The types form a ladder: boolean, bigint, double, string.  A column gets the first
rung that reads every one of its texts; all columns are counted in one aggregate
over the whole table, and only one row of counts per column reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.schema import quoted

# --- fixed values: the texts that a CSV reader of the pandas kind takes as truth values ---
TRUE_TEXTS = ["True", "TRUE", "true"]
FALSE_TEXTS = ["False", "FALSE", "false"]

WHOLE = r"^[ \t]*[+-]?[0-9]+[ \t]*$"
DECIMAL = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"
INFINITE = r"^[ \t]*[+-]?(?i:inf|infinity)[ \t]*$"
SCHEMA = "column_name string, type string, texts long, missing long, booleans long, integers long, doubles long"


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(" \t"))


def _as_long(c: Column) -> Column:
    """Whole numbers of 64 bits; other texts are null."""
    return F.when(c.rlike(WHOLE), _trimmed(c).try_cast("bigint"))


def _as_double(c: Column) -> Column:
    return F.when(c.rlike(DECIMAL), _trimmed(c).try_cast("double")).when(
        c.rlike(INFINITE), F.when(_trimmed(c).startswith("-"), float("-inf")).otherwise(float("inf")))


def infer_types(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, type, texts, missing, booleans, integers, doubles) of the text columns among ``cols``.

    A column without a text is DOUBLE, as in pandas.  Truth values need a column
    without gaps (pandas keeps texts otherwise).  Whole numbers beyond 64 bits are
    doubles.  An empty table has one row of zeros per column.
    """
    names = [c for c in (cols if cols is not None else df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], SCHEMA)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        c = F.col(quoted(name))
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.isin(TRUE_TEXTS + FALSE_TEXTS)).alias(f"b{i}"),
                 F.count(_as_long(c)).alias(f"l{i}"), F.count(_as_double(c)).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, name in enumerate(names):
        n, b, whole, real = (row[f"{k}{i}"] for k in "nbld")
        kind = "boolean" if n and b == n == row["rows"] else "bigint" if n and whole == n else "double" if real == n else "string"
        out.append((name, kind, n, row["rows"] - n, b, whole, real))
    return spark.createDataFrame(out, SCHEMA)


def apply_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns converted to the types of ``kinds`` (by column); a text that doesn't fit becomes NULL."""
    read = {"boolean": lambda c: F.when(c.isin(TRUE_TEXTS), True).when(c.isin(FALSE_TEXTS), False),
            "bigint": _as_long, "double": _as_double, "string": lambda c: c}
    return df.select(*[read[kinds.get(n, "string")](F.col(quoted(n))).alias(n) if n in kinds else F.col(quoted(n)) for n in df.columns])


def typed(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the text columns among ``cols`` in their inferred types."""
    kinds = {r["column_name"]: r["type"] for r in infer_types(df, cols).collect()}      # one row per column
    return apply_types(df, kinds) if kinds else df
