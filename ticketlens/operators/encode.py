"""label encoding of categorical columns.

Code = position of the value among the column's sorted distinct values
(binary string order = code-point order, as Python sorts), from 0.  A missing
value is encoded as the text ``nan``.

Plan: the columns are unpivoted to (column, value) and de-duplicated with a
partial aggregate (hot values collapse map-side), numbered per column with
range-partitioned prefix offsets (``numbering.dense_codes``: a column with
very many distinct values is spread over several tasks), and joined back.  The
dictionaries are broadcast while their bytes, summed over all columns, stay under
``broadcast_bytes``; beyond that, the largest are shuffle-joined.  There the
values that hold more than a hundredth of the rows (fewer than a hundred per
column) are coded by a small map in the scan, so none of them meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens import schema as S
from ticketlens.functions import as_text
from ticketlens.operators.numbering import dense_codes

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 100          # a value with more than 1 / HOT_SHARE of the rows is coded in the scan


def categorical_columns(df: DataFrame, target_col: str | None = None,
                        exclude: list[str] = S.ENCODE_EXCLUDE) -> list[str]:
    return [c for c in S.string_columns(df) if c != target_col and c not in exclude]


def label_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, code) for every column, codes dense from 0."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), as_text(c).alias("value")) for c in cols
    ])).alias("kv")).select("kv.column_name", "kv.value").distinct()
    return dense_codes(long, "column_name", "value", "code")


def encode_categorical_features(df: DataFrame, target_col: str | None = None,
                                broadcast_bytes: int = BROADCAST_BYTES
                                ) -> tuple[DataFrame, list[str], list[str], DataFrame]:
    """Add ``{col}_encoded`` for every categorical column.

    Returns (frame, categorical columns, numerical columns, dictionary).
    """
    cats = categorical_columns(df, target_col)
    nums = [c for c in S.numeric_columns(df) if c != target_col and not c.endswith("_encoded")]
    if not cats:
        return df, cats, nums, None
    dictionary = label_dictionary(df, cats)          # written once by dense_codes
    sizes = {r["column_name"]: r["n"] for r in dictionary.groupBy("column_name").agg(
        F.sum(F.octet_length("value") + 16).alias("n")).collect()}
    left, small = broadcast_bytes, set()
    for c in sorted(cats, key=lambda c: sizes.get(c, 0)):
        left -= sizes.get(c, 0)
        if left >= 0:
            small.add(c)
    out = df
    for c in cats:
        d = (dictionary.where(F.col("column_name") == c)
             .select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}")))
        if c in small:
            out = out.withColumn(f"_v_{c}", as_text(c)).join(F.broadcast(d), f"_v_{c}", "left")
            out = out.withColumn(f"{c}_encoded", F.col(f"_c_{c}"))
        else:
            out = _join_around_hot_values(out, c, d)
        out = out.drop(f"_v_{c}", f"_c_{c}")
    return out, cats, nums, dictionary


def _join_around_hot_values(df: DataFrame, c: str, d: DataFrame) -> DataFrame:
    counts = df.groupBy(as_text(c).alias(f"_v_{c}")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    hot = {r[0]: r[1] for r in counts.where(F.col("n") * HOT_SHARE > total).join(d, f"_v_{c}")
           .select(f"_v_{c}", f"_c_{c}").collect()}                        # fewer than HOT_SHARE values
    code = F.lit(None).cast("int")
    for v, k in hot.items():
        code = F.when(F.col(f"_v_{c}") == F.lit(v), F.lit(k)).otherwise(code)
    out = df.withColumn(f"_v_{c}", as_text(c)).withColumn(f"_hot_{c}", code)
    # hot rows need no partner: a salted text that no dictionary holds deals them out over all tasks
    # (should one hold it, the hot code still wins, and values are distinct there)
    salt = F.concat(F.lit("\x00\x00"), F.pmod(F.xxhash64(*df.columns), F.lit(1000)).cast("string"))
    out = out.withColumn(f"_k_{c}", F.when(F.col(f"_hot_{c}").isNull(), F.col(f"_v_{c}")).otherwise(salt))
    d = d.withColumnRenamed(f"_v_{c}", f"_w_{c}")
    out = out.join(d, F.col(f"_k_{c}") == F.col(f"_w_{c}"), "left")
    return (out.withColumn(f"{c}_encoded", F.coalesce(f"_hot_{c}", f"_c_{c}"))
            .drop(f"_hot_{c}", f"_k_{c}", f"_w_{c}"))
