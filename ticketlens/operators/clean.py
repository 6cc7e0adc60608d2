"""Cleaning: timestamp coercion, response time, de-duplication, fills,
outlier capping and text normalisation.

Job shape of ``clean_data`` (see the module README for the plan):
one aggregate on the raw rows (row count, mean response time), the
de-duplication (digests of all rows are shuffled, whole rows only where a digest
occurs twice; its output is written to the checkpoint folder once), one aggregate for every null
count, one value-count shuffle for all modes, a few small passes for exact
medians, then one projection applies every fill and the result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import schema as S
from ticketlens.functions import clip, contains_any, has_remarks_flag, lower_text, minutes_between, text_length
from ticketlens.operators.formats import inferred, text_columns
from ticketlens.operators.numbering import number_rows, row_tie_break
from ticketlens.operators.order_stats import exact_medians, exact_quantiles, modes
from ticketlens.operators.quality import row_digest
from ticketlens.session import materialize, release
from ticketlens.sources.tickets import join_texts

#: unambiguous patterns; day-first and month-first texts need ``formats``
DEFAULT_TS_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]
GENERATED_ID_PREFIX = "generated_order_"
DIGEST_BITS = 1 << 27


def convert_datetimes(df: DataFrame, cols: list[str] = S.DATETIME_COLS,
                      formats: dict[str, str | list[str]] | str | list[str] | None = None) -> DataFrame:
    """Coerce columns to naive timestamps; unparsable text becomes NULL.

    Text is parsed with the first of its candidate patterns that fits, none is
    guessed here (``clean_data`` infers them): ``formats`` is one pattern or a list for all columns, or a dict
    by column.  Typed timestamps are normalised to TIMESTAMP_NTZ.
    """
    exprs = {}
    for c in cols:
        if c not in df.columns:
            continue
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            exprs[c] = F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in _patterns(formats, c)]).cast("timestamp_ntz")
        elif isinstance(dtype, (T.TimestampType, T.DateType)):
            exprs[c] = F.col(c).cast("timestamp_ntz")
    return df.withColumns(exprs) if exprs else df


def _patterns(formats, col: str) -> list[str]:
    chosen = formats.get(col, DEFAULT_TS_FORMATS) if isinstance(formats, dict) else (formats or DEFAULT_TS_FORMATS)
    return [chosen] if isinstance(chosen, str) else list(chosen)


def check_parsed(text: DataFrame, parsed: DataFrame, cols: list[str] = S.DATETIME_COLS) -> dict[str, int]:
    """Texts per column that no pattern fitted; raises if a column with texts came out all NULL."""
    cols = [c for c in cols if c in text.columns and isinstance(text.schema[c].dataType, T.StringType)]
    if not cols:
        return {}
    row = text.agg(*[F.count(c).alias(c) for c in cols]).first()
    got = parsed.agg(*[F.count(c).alias(c) for c in cols]).first()
    lost = [c for c in cols if row[c] and not got[c]]
    if lost:
        raise ValueError(f"no timestamp pattern fits any text of {', '.join(lost)}; pass formats=")
    return {c: row[c] - got[c] for c in cols}


def add_response_time(df: DataFrame) -> DataFrame:
    """``response_time_minutes`` = responded - reported, signed."""
    if S.REPORTED in df.columns and S.RESPONDED in df.columns:
        return df.withColumn("response_time_minutes", minutes_between(S.REPORTED, S.RESPONDED))
    return df


def drop_duplicate_rows(df: DataFrame, row: str | None = None) -> DataFrame:
    """One copy of each full-row duplicate; rows that occur once stay in their tasks.

    A first pass shuffles two 64-bit digests per row and finds those that occur
    twice or more.  They become a set of ``DIGEST_BITS`` bits, which is 16 MB at any
    size.  A second pass lets every row whose bit is clear through: no copy of it
    exists.  Only the others travel whole and are compared in all their columns, so
    neither equal digests nor shared bits change the result.  ``row`` names a row number
    that is not compared; the smallest of the copies stays.
    """
    compared = df.drop(row) if row else df
    h1, h2 = row_digest(compared)
    place = lambda h: F.pmod(h, F.lit(DIGEST_BITS))
    twice = df.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = twice.select((F.bitmap_bucket_number(place(F.col("h1")) + 1)).alias("_bucket"), F.bitmap_bit_position(place(F.col("h1")) + 1).alias("_bit"))
    bits = at.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))     # at most DIGEST_BITS / 32,768 rows of 4 KB
    spot = place(h1) + 1
    rows = df.select(F.struct(*[F.col(S.quoted(c)).alias(c) for c in df.columns]).alias("_row"),
                     F.bitmap_bucket_number(spot).alias("_at"), F.bitmap_bit_position(spot).alias("_p"))
    rows = rows.join(F.broadcast(bits), F.col("_at") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.select("_row", F.coalesce(F.call_function("shiftright", byte, (F.col("_p") % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False)).alias("_seen"))
    marked = rows.select("_seen", "_row.*")
    names = [F.col(S.quoted(c)) for c in df.columns]
    seen = marked.where("_seen")
    once = (seen.groupBy(*[F.col(S.quoted(c)) for c in compared.columns]).agg(F.min(row).alias(row)) if row
            else seen.select(*names).dropDuplicates())
    return marked.where(~F.col("_seen")).select(*names).unionByName(once.select(*names))


def set_aside(df: DataFrame, row: str) -> DataFrame:
    """The rows without their remarks, the one long column, and with ``S.HELD`` instead.

    That struct holds the row's number in the written table, the tie-break over all its
    columns and what the later steps read off the cleaned remarks, so none of them
    writes or shuffles a text.  ``with_remarks`` brings the texts back.
    """
    text = F.coalesce(F.col(S.REMARKS), F.lit("Unknown"))
    low = lower_text(text)
    held = F.struct(F.col(row).alias("row"), row_tie_break(df.drop(row)).alias("tie"), F.col(S.REMARKS).isNull().alias("missing"),
                    text_length(low).alias("remarks_length"), contains_any(text).alias("has_urgent_keywords"),
                    has_remarks_flag(text).alias("has_customer_remarks"))
    return df.select(*[F.col(S.quoted(c)) for c in df.columns if c not in (row, S.REMARKS)], held.alias(S.HELD))


def with_remarks(df: DataFrame, loaded: DataFrame, row: str, lower: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """``df`` with the cleaned remarks (``lower``: normalised) in their place among the columns of ``loaded``.

    ``texts`` is the table of remarks that the rows' numbers point into (``sources.tickets.join_texts``).
    """
    text = F.coalesce(F.col("_text"), F.lit("Unknown"))
    if texts is not None:
        out = join_texts(df, f"{S.HELD}.row", texts)
    else:
        found = loaded.select(F.col(row).alias("_at"), F.col(S.REMARKS).alias("_text"))
        out = df.join(found, F.col(f"{S.HELD}.row") == F.col("_at"))
    out = out.withColumn(S.REMARKS, lower_text(text) if lower else text)
    first = [c for c in loaded.columns if c != row]
    return out.select(*[F.col(S.quoted(c)) for c in first], *[F.col(S.quoted(c)) for c in df.columns if c not in (*first, S.HELD)])


def generate_ids(df: DataFrame, col: str = S.ORDER_ID, key_col: str = S.UNIQUE_ID,
                 prefix: str = GENERATED_ID_PREFIX) -> DataFrame:
    """NULL ids become ``{prefix}{i}``, i dense from 0 in (md5(key), key) order."""
    numbered = number_rows(df, F.col(col).isNull(), key_col, "_gen", F.col(f"{S.HELD}.tie") if S.HELD in df.columns else None)
    filled = F.coalesce(F.col(col), F.concat(F.lit(prefix), F.col("_gen").cast("string")))
    return numbered.withColumn(col, filled).drop("_gen").select(*[S.quoted(c) for c in df.columns])


def clean_data(df: DataFrame, formats=None, dedup: bool = True, row: str | None = None
               ) -> tuple[DataFrame, dict]:
    """The composite cleaning step; returns the cleaned frame and stats.

    ``dedup=False`` is the satisfaction pipeline's variant (no C3).  Without
    ``formats`` the pattern of every text column of timestamps is inferred from
    all its texts (``formats.infer_formats``).

    ``row`` names a column of ``df`` that numbers its rows, ``S.ROW`` if the loaded
    table of some stages is given; the numbers must be written ones.  The cleaned frame has ``S.HELD`` in place of the remarks
    (``set_aside``), which ``with_remarks`` brings back.
    """
    stats: dict = {}
    row = S.ROW if row is None and S.ROW in df.columns and df.schema[S.ROW].metadata.get("numbers") else row
    if formats is None and text_columns(df, S.DATETIME_COLS):
        formats, ambiguous = inferred(df, S.DATETIME_COLS, DEFAULT_TS_FORMATS)
        if ambiguous:
            stats["ambiguous_timestamps"] = ambiguous
    text, df = df, convert_datetimes(df, formats=formats)
    unparsed = check_parsed(text, df)
    if any(unparsed.values()):
        stats["unparsed_timestamps"] = unparsed
    df = add_response_time(df)

    first = df.agg(F.count(F.lit(1)).alias("n"),
                   *([F.avg("response_time_minutes").alias("rt")]
                     if "response_time_minutes" in df.columns else []))
    first = first.first()
    if "response_time_minutes" in df.columns:
        stats["mean_response_time"] = first["rt"]

    deduped = drop_duplicate_rows(df, row) if dedup else df
    deduped = materialize(set_aside(deduped, row) if row else deduped, "deduped")
    nulls_and_rows = deduped.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(S.quoted(c)).isNull()).alias(f"_{i}") for i, c in enumerate(deduped.columns)],
        *([F.count_if(f"{S.HELD}.missing").alias("_text")] if row else []),
        *([F.count_if(F.col(S.ORDER_TS).isNull() & F.col(S.REPORTED).isNull()).alias("_both")]
          if S.ORDER_TS in deduped.columns and S.REPORTED in deduped.columns else [])).first()
    removed = first["n"] - nulls_and_rows["_rows"]
    if removed > 0:
        stats["duplicates_removed"] = removed
    nulls = {c: nulls_and_rows[f"_{i}"] for i, c in enumerate(deduped.columns)}
    if row:
        nulls[S.REMARKS] = nulls_and_rows["_text"]

    fills = {}
    remaining = dict(nulls)

    mode_cols = [c for c in S.MODE_FILL_COLS if c in deduped.columns and nulls[c] > 0]
    for c, m in modes(deduped, mode_cols).items():
        if m is not None:
            fills[c] = F.coalesce(F.col(c), F.lit(m).cast(deduped.schema[c].dataType))
            stats[f"{c}_filled"] = nulls[c]
            remaining[c] = 0

    out = deduped
    if S.ORDER_ID in deduped.columns and nulls[S.ORDER_ID] > 0:
        out = generate_ids(out)
        stats["order_id_generated"] = nulls[S.ORDER_ID]
        remaining[S.ORDER_ID] = 0

    med_cols = [c for c in S.MEDIAN_FILL_COLS if c in deduped.columns and nulls[c] > 0]
    for c, m in exact_medians(deduped, med_cols).items():
        if m is not None:
            fills[c] = F.coalesce(F.col(c), F.lit(m).cast(deduped.schema[c].dataType))
            stats[f"{c}_filled"] = nulls[c]
            remaining[c] = 0

    for c in S.UNKNOWN_FILL_COLS:
        if nulls.get(c, 0) > 0:
            if c in deduped.columns:                     # remarks that are set aside come back filled
                fills[c] = F.coalesce(F.col(c), F.lit("Unknown"))
            stats[f"{c}_filled"] = nulls[c]
            remaining[c] = 0

    if S.ORDER_TS in deduped.columns and S.REPORTED in deduped.columns and nulls[S.ORDER_TS] > 0:
        fills[S.ORDER_TS] = F.coalesce(F.col(S.ORDER_TS), F.col(S.REPORTED))
        stats["order_date_time_filled"] = nulls[S.ORDER_TS]
        remaining[S.ORDER_TS] = nulls_and_rows["_both"]

    if fills:
        out = out.withColumns(fills)
    # written: later passes (quantiles, reports, models) read a few columns of it
    # instead of numbering ids again, and every reader sees the same ids
    out = materialize(out, "cleaned")
    release(deduped)
    stats["remaining_missing"] = sum(remaining.values())
    return out, stats


def outlier_columns(df: DataFrame, target_col: str | None = None) -> list[str]:
    """Numeric columns that capping touches: not the target, name not ending in 'id'."""
    return [c for c in S.numeric_columns(df)
            if not c.lower().endswith("id") and c != target_col]


def outlier_bounds(df: DataFrame, target_col: str | None = None, k: float = 1.5
                   ) -> tuple[dict[str, int], dict[str, tuple[float, float]]]:
    """(outliers, bounds [Q1 - k*IQR, Q3 + k*IQR]) per examined column with values."""
    cols = outlier_columns(df, target_col)
    df = df.select(*[S.quoted(c) for c in cols])
    q = exact_quantiles(df, cols, [0.25, 0.75])
    bounds = {}
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        bounds[c] = (q1 - k * iqr, q3 + k * iqr)
    if not bounds:
        return {}, {}
    row = df.agg(*[F.count_if((F.col(S.quoted(c)) < lo) | (F.col(S.quoted(c)) > hi)).alias(f"_{i}")
                   for i, (c, (lo, hi)) in enumerate(bounds.items())]).first()
    return {c: row[f"_{i}"] for i, c in enumerate(bounds)}, bounds


def cap_outliers(df: DataFrame, target_col: str | None = None, k: float = 1.5
                 ) -> tuple[DataFrame, dict[str, int], dict[str, tuple[float, float]]]:
    """Cap to [Q1 - k*IQR, Q3 + k*IQR]; only columns with outliers change value.

    Returns the frame, outliers per capped column, and the bounds used.
    """
    counts, bounds = outlier_bounds(df, target_col, k)
    capped = {c: n for c, n in counts.items() if n > 0}
    # every examined column comes out DOUBLE (pandas turns a clipped integer
    # column into float64); the type then does not depend on the data
    exprs = {c: (clip(F.col(S.quoted(c)).cast("double"), float(bounds[c][0]), float(bounds[c][1]))
                 if c in capped else F.col(S.quoted(c)).cast("double"))
             for c in bounds}
    return (df.withColumns(exprs) if exprs else df), capped, bounds


def normalize_text(df: DataFrame, cols: list[str] = (S.REMARKS,)) -> DataFrame:
    """C11: text rendering (missing -> 'nan') lower-cased."""
    exprs = {c: lower_text(c) for c in cols if c in df.columns}
    return df.withColumns(exprs) if exprs else df


def preprocess_data(df: DataFrame, target_col: str | None = None) -> DataFrame:
    """C10 + C11 as one step."""
    capped, _, _ = cap_outliers(df, target_col)
    return normalize_text(capped)
