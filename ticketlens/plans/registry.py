"""Registered queries (Spark) and their DuckDB oracle twins.

Doubles are rounded to 6 decimals on both sides at the very end, so sums
taken in a different order compare equal.  Names describe the table
produced; the SURVEY operator ids are noted per entry.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import schema as S
from ticketlens.operators import quality as Q
from ticketlens.functions import contains_any
from ticketlens.operators import reports as R
from ticketlens.operators.clean import add_response_time, convert_datetimes, drop_duplicate_rows
from ticketlens.operators.encode import label_dictionary
from ticketlens.operators.features import add_csat_features
from ticketlens.operators.formats import CANDIDATES, SWAPPED, infer_formats
from ticketlens.plans.pipelines import delay_stages, numbered
from ticketlens.plans import sql_twins as TW
from ticketlens.plans.sql_twins import ENCODED_COLS, with_stage
from ticketlens.session import materialize, release
from ticketlens.sources.tickets import tickets
from ticketlens.sources.types import infer_types

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run
    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    exprs = {f.name: F.round(F.col(f.name), places) for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(exprs) if exprs else df


def rounded_sql(sql: str, cols: list[str]) -> str:
    rep = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _q" if cols else sql


def featured(spark, sf_dir):
    """The featured rows without their remarks, which no report reads."""
    return delay_stages(spark, sf_dir).featured_rows


def raw(spark, sf_dir):
    return delay_stages(spark, sf_dir).raw


# ---------------------------------------------------------------- sources
RAW_DOUBLES = ["item_price", "connected_handling_time"]


@register("tickets_raw", rounded_sql(with_stage("tickets", "SELECT * FROM tickets"), RAW_DOUBLES))
def _tickets_raw(spark, sf_dir):
    """The derived ticket table as loaded (17 columns, duplicates kept)."""
    return tickets(spark, sf_dir)


# ---------------------------------------------------------------- profiling
_RAW_COLS = ["unique_id", "channel_name", "category", "sub_category", "customer_remarks", "order_id",
             "order_date_time", "issue_reported_at", "issue_responded", "survey_response_date",
             "customer_city", "product_category", "item_price", "connected_handling_time",
             "tenure_bucket", "agent_shift", "csat_score"]

_nulls_union = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS missing_values, "
    f"count_if({c} IS NULL) * 100.0::DOUBLE / count(*) AS percentage FROM tickets" for c in _RAW_COLS)


@register("quality_nulls", rounded_sql(with_stage(
    "tickets", f"SELECT * FROM ({_nulls_union}) WHERE missing_values > 0"), ["percentage"]))
def _quality_nulls(spark, sf_dir):
    """Q1: missing count and percent per column, columns with nulls only."""
    return Q.missing_report(raw(spark, sf_dir))


@register("quality_duplicates", rounded_sql(with_stage("tickets", """
SELECT CAST(n - d AS BIGINT) AS duplicates, (n - d) * 100.0::DOUBLE / n AS duplicate_percent
FROM (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM tickets)) AS d FROM tickets)"""),
    ["duplicate_percent"]))
def _quality_duplicates(spark, sf_dir):
    """Q2: rows beyond the first copy of each full-row duplicate."""
    return Q.duplicate_report(raw(spark, sf_dir))


_DESC_COLS = ["item_price", "connected_handling_time", "csat_score"]
_desc_union = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM tickets" for c in _DESC_COLS)


@register("quality_describe", rounded_sql(with_stage("tickets", _desc_union),
                                          ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def _quality_describe(spark, sf_dir):
    """Q3: count, mean, sample std, min, quartiles, max of numeric columns."""
    return Q.describe(raw(spark, sf_dir))


_TOP5_COLS = ["unique_id", "channel_name", "category", "sub_category", "customer_remarks"]
_top5_union = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM tickets "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _TOP5_COLS)


@register("quality_top_values", with_stage("tickets", f"""
SELECT column_name, value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
  FROM ({_top5_union})) WHERE rank <= 5"""))
def _quality_top_values(spark, sf_dir):
    """Q4: top-5 value counts of the first five text columns."""
    return Q.top_values_report(raw(spark, sf_dir))


@register("quality_summary", rounded_sql(with_stage("tickets", f"""
SELECT count(*) AS total_rows, {len(_RAW_COLS)} AS total_columns,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tickets)) AS BIGINT) AS duplicates,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tickets))) * 100.0::DOUBLE / count(*) AS duplicate_percent,
  CAST(({' + '.join(f'count_if({c} IS NULL)' for c in _RAW_COLS)}) AS BIGINT) AS total_missing
FROM tickets"""), ["duplicate_percent"]))
def _quality_summary(spark, sf_dir):
    """Q5/Q6/Q7: rows, columns, duplicates and total missing cells (one row)."""
    return Q.quality_summary(raw(spark, sf_dir))


@register("tickets_head", rounded_sql(with_stage(
    "tickets", "SELECT * FROM tickets ORDER BY unique_id, customer_remarks LIMIT 5"), RAW_DOUBLES))
def _tickets_head(spark, sf_dir):
    """Q6: first rows (by ticket id) -- a top-k by design."""
    return Q.head(raw(spark, sf_dir), 5)


@register("target_distribution", rounded_sql(with_stage("featured", """
SELECT is_delayed, count(*) AS count, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM featured) AS share
FROM featured GROUP BY is_delayed"""), ["share"]))
def _target_distribution(spark, sf_dir):
    """Q8: rows and share per target value."""
    return Q.target_distribution(featured(spark, sf_dir), S.TARGET)


# ---------------------------------------------------------------- cleaning
CLEAN_DOUBLES = ["item_price", "connected_handling_time", "response_time_minutes"]


@register("clean_tickets", rounded_sql(with_stage("cleaned", "SELECT * FROM cleaned"), CLEAN_DOUBLES))
def _clean_tickets(spark, sf_dir):
    """Cleaned table (parsed times, response time, no duplicates, fills)."""
    return delay_stages(spark, sf_dir).clean


@register("clean_stats", rounded_sql(with_stage("cleaned", f"""
SELECT (SELECT avg(response_time_minutes) FROM conv) AS mean_response_time,
  CAST((SELECT count(*) FROM conv) - (SELECT count(*) FROM dedup) AS BIGINT) AS duplicates_removed,
  {', '.join(f"(SELECT count_if({c} IS NULL) FROM dedup) AS {c}_{'generated' if c == 'order_id' else 'filled'}"
             for c in TW.MODE_FILLED + ["order_id"] + TW.MEDIAN_FILLED + TW.UNKNOWN_FILLED + ["order_date_time"])},
  CAST(({' + '.join(f'count_if({c} IS NULL)' for c in _RAW_COLS + ['response_time_minutes'])}) AS BIGINT)
    AS remaining_missing
FROM cleaned"""), ["mean_response_time"]))
def _clean_stats(spark, sf_dir):
    """C9 stats record and Q7 remaining missing cells, one row."""
    return Q.clean_stats_frame(spark, delay_stages(spark, sf_dir).clean_stats)


PRE_DOUBLES = ["item_price", "connected_handling_time", "csat_score", "response_time_minutes"]


@register("preprocessed_tickets", rounded_sql(with_stage("pre", "SELECT * FROM pre"), PRE_DOUBLES))
def _preprocessed(spark, sf_dir):
    """Outliers capped (IQR rule), remarks lower-cased."""
    return delay_stages(spark, sf_dir).preprocessed


# ---------------------------------------------------------------- features
FEAT_DOUBLES = PRE_DOUBLES + ["ticket_age_days", "resolution_time_hours"]


@register("featured_tickets", rounded_sql(with_stage("featured", "SELECT * FROM featured"), FEAT_DOUBLES))
def _featured(spark, sf_dir):
    """Every engineered column plus label codes."""
    return delay_stages(spark, sf_dir).featured


_dict_union = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column_name, coalesce({c}, 'nan') AS value FROM featured" for c in ENCODED_COLS)


@register("label_dictionary", with_stage("featured", f"""
SELECT column_name, value, CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS code
FROM ({_dict_union})"""))
def _label_dictionary(spark, sf_dir):
    """value -> code dictionary of every encoded column."""
    st = delay_stages(spark, sf_dir)
    return label_dictionary(st.featured_rows, st.info.categorical_columns)


@register("csat_features", with_stage("cleaned", """
SELECT unique_id, dayname(issue_reported_at) AS issue_day_of_week,
  CAST(hour(issue_reported_at) AS INTEGER) AS issue_hour,
  CASE WHEN customer_remarks = 'Unknown' THEN 0 ELSE 1 END AS has_customer_remarks
FROM cleaned"""))
def _csat_features(spark, sf_dir):
    """The satisfaction pipeline's three derived columns."""
    return (add_csat_features(delay_stages(spark, sf_dir).clean_rows)
            .select(S.UNIQUE_ID, "issue_day_of_week", "issue_hour", "has_customer_remarks"))


# ---------------------------------------------------------------- reports
def _fsql(body: str, doubles: list[str] = ()) -> str:
    return rounded_sql(with_stage("featured", body), list(doubles))


@register("delay_by_category", _fsql("""
SELECT category, count_if(is_delayed = 0) AS on_time, count_if(is_delayed = 1) AS delayed,
  CAST(count_if(is_delayed = 1) AS DOUBLE) * 100.0::DOUBLE / CAST(count(*) AS DOUBLE) AS delayed_pct
FROM featured WHERE category IS NOT NULL AND is_delayed IS NOT NULL GROUP BY category
ORDER BY delayed_pct DESC NULLS LAST, category LIMIT 10""", ["delayed_pct"]))
def _delay_by_category(spark, sf_dir):
    """On-time / delayed counts and delayed percent per category, top 10."""
    return R.resolution_by_category(featured(spark, sf_dir))


_TREND = {
    "daily_volume": ("CAST(issue_reported_at AS DATE)", "date", R.daily_volume),
    "hourly_volume": ("CAST(hour(issue_reported_at) AS INTEGER)", "hour", R.hourly_volume),
    "weekday_volume": ("CAST(isodow(issue_reported_at) - 1 AS INTEGER)", "day_of_week", R.weekday_volume),
    "monthly_volume": ("CAST(month(issue_reported_at) AS INTEGER)", "month", R.monthly_volume),
}
for _name, (_expr, _key, _fn) in _TREND.items():
    register(_name, _fsql(f"SELECT {_expr} AS {_key}, count(*) AS ticket_count FROM featured "
                          f"WHERE issue_reported_at IS NOT NULL GROUP BY 1"))(
        lambda spark, sf_dir, _fn=_fn: _fn(featured(spark, sf_dir)))

_RATE = {
    "daily_delay_rate": ("CAST(issue_reported_at AS DATE)", "date", R.daily_delay_rate),
    "hourly_delay_rate": ("CAST(hour(issue_reported_at) AS INTEGER)", "hour", R.hourly_delay_rate),
    "weekday_delay_rate": ("CAST(isodow(issue_reported_at) - 1 AS INTEGER)", "day_of_week", R.weekday_delay_rate),
}
for _name, (_expr, _key, _fn) in _RATE.items():
    register(_name, _fsql(f"SELECT {_expr} AS {_key}, avg(is_delayed) AS delayed_rate FROM featured "
                          f"WHERE issue_reported_at IS NOT NULL GROUP BY 1", ["delayed_rate"]))(
        lambda spark, sf_dir, _fn=_fn: _fn(featured(spark, sf_dir)))


@register("top_categories", _fsql("""
SELECT category, count(*) AS count FROM featured WHERE category IS NOT NULL
GROUP BY category ORDER BY count DESC, category LIMIT 10"""))
def _top_categories(spark, sf_dir):
    """Ten most frequent categories."""
    return R.top_values(featured(spark, sf_dir), "category", 10)


_DIST_COLS = ["channel_name", "category", "sub_category", "customer_city", "product_category"]
_dist_union = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM featured "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _DIST_COLS)


@register("distribution_top_values", _fsql(f"""
SELECT column_name, value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
  FROM ({_dist_union})) WHERE rank <= 10"""))
def _distribution_top_values(spark, sf_dir):
    """A21 (text part): top-10 values of the first five categorical features."""
    st = delay_stages(spark, sf_dir)
    return R.top_values_many(st.featured_rows, st.info.categorical_columns[:5], 10)


@register("agent_workload", _fsql("""
SELECT agent_shift, count(*) AS ticket_count FROM featured WHERE agent_shift IS NOT NULL
GROUP BY agent_shift ORDER BY ticket_count DESC, agent_shift LIMIT 15"""))
def _agent_workload(spark, sf_dir):
    """A10: tickets per agent shift, busiest 15."""
    return R.agent_workload(featured(spark, sf_dir))


@register("agent_performance", _fsql("""
SELECT agent_shift, avg(is_delayed) AS delayed_rate, count(is_delayed) AS ticket_count
FROM featured WHERE agent_shift IS NOT NULL GROUP BY agent_shift HAVING count(is_delayed) >= 10""",
    ["delayed_rate"]))
def _agent_performance(spark, sf_dir):
    """Delay rate per agent shift with at least 10 tickets."""
    return R.agent_performance(featured(spark, sf_dir))


_perf = ("SELECT agent_shift, avg(is_delayed) AS delayed_rate, count(is_delayed) AS ticket_count "
         "FROM featured WHERE agent_shift IS NOT NULL GROUP BY agent_shift HAVING count(is_delayed) >= 10")


@register("best_worst_agents", _fsql(f"""
(SELECT *, 'best' AS side FROM ({_perf}) ORDER BY delayed_rate, agent_shift LIMIT 10)
UNION ALL
(SELECT *, 'worst' AS side FROM ({_perf}) ORDER BY delayed_rate DESC, agent_shift DESC LIMIT 10)""",
    ["delayed_rate"]))
def _best_worst(spark, sf_dir):
    """Ten lowest and ten highest delay rates."""
    return R.best_worst_agents(featured(spark, sf_dir))


@register("workload_vs_performance", _fsql("""
SELECT agent_shift, avg(is_delayed) AS delayed_rate, count(unique_id) AS ticket_count
FROM featured WHERE agent_shift IS NOT NULL GROUP BY agent_shift""", ["delayed_rate"]))
def _workload_vs_perf(spark, sf_dir):
    """Delay rate and workload per agent shift, no minimum."""
    return R.workload_vs_performance(featured(spark, sf_dir))


@register("status_counts", _fsql("""
SELECT CASE is_delayed WHEN 1 THEN 'Delayed' WHEN 0 THEN 'On-time' END AS status, count(*) AS count
FROM featured WHERE is_delayed IN (0, 1) GROUP BY 1"""))
def _status_counts(spark, sf_dir):
    """Tickets per status label."""
    return R.status_counts(featured(spark, sf_dir))


@register("status_by_top_categories", _fsql("""
SELECT category, count_if(is_delayed = 1) AS Delayed, count_if(is_delayed = 0) AS On_time
FROM featured WHERE category IN (
  SELECT category FROM featured WHERE category IS NOT NULL GROUP BY category
  ORDER BY count(*) DESC, category LIMIT 10) AND is_delayed IS NOT NULL
GROUP BY category"""))
def _status_by_top_categories(spark, sf_dir):
    """Status crosstab of the ten busiest categories."""
    return R.status_by_top_categories(featured(spark, sf_dir))


@register("top_delay_rate_categories", _fsql("""
SELECT category, avg(is_delayed) AS delayed_rate FROM featured WHERE category IS NOT NULL
GROUP BY category ORDER BY delayed_rate DESC, category LIMIT 10""", ["delayed_rate"]))
def _top_delay_rate_categories(spark, sf_dir):
    """Ten categories with the highest delay rate."""
    return R.top_delay_rate_categories(featured(spark, sf_dir))


@register("response_summary", _fsql("""
SELECT avg(response_time_minutes) AS mean_response_time, CAST(sum(is_delayed) AS BIGINT) AS delayed_count,
  avg(is_delayed) * 100 AS delayed_pct FROM featured""", ["mean_response_time", "delayed_pct"]))
def _response_summary(spark, sf_dir):
    """Mean (capped) response time; delayed count and percent."""
    return R.response_summary(featured(spark, sf_dir))


# ---------------------------------------------------------------- the cuts of the reports, on columns with more groups than they keep
_CITY = "customer_city"
_CITY_RATE = (f"SELECT {_CITY}, avg(is_delayed) AS delayed_rate, count(is_delayed) AS ticket_count "
              f"FROM featured WHERE {_CITY} IS NOT NULL GROUP BY {_CITY} HAVING count(is_delayed) >= 10")


@register("delay_by_city", _fsql(f"""
SELECT {_CITY}, count_if(is_delayed = 0) AS on_time, count_if(is_delayed = 1) AS delayed,
  count_if(is_delayed = 1) * 100.0::DOUBLE / count(*) AS delayed_pct
FROM featured WHERE {_CITY} IS NOT NULL AND is_delayed IS NOT NULL GROUP BY {_CITY}
ORDER BY delayed_pct DESC NULLS LAST, {_CITY} LIMIT 10""", ["delayed_pct"]))
def _delay_by_city(spark, sf_dir):
    """A8 where the top 10 cuts (21 cities)."""
    return R.resolution_by_category(featured(spark, sf_dir), _CITY)


@register("city_workload", _fsql(f"""
SELECT {_CITY}, count(*) AS ticket_count FROM featured WHERE {_CITY} IS NOT NULL
GROUP BY {_CITY} ORDER BY ticket_count DESC, {_CITY} LIMIT 15"""))
def _city_workload(spark, sf_dir):
    """A10 where the top 15 cuts."""
    return R.agent_workload(featured(spark, sf_dir), _CITY)


@register("best_worst_cities", _fsql(f"""
(SELECT *, 'best' AS side FROM ({_CITY_RATE}) ORDER BY delayed_rate, {_CITY} LIMIT 10)
UNION ALL
(SELECT *, 'worst' AS side FROM ({_CITY_RATE}) ORDER BY delayed_rate DESC, {_CITY} DESC LIMIT 10)""", ["delayed_rate"]))
def _best_worst_cities(spark, sf_dir):
    """A12 where both sides cut."""
    return R.best_worst_agents(featured(spark, sf_dir), _CITY)


@register("status_by_top_sub_categories", _fsql("""
SELECT sub_category, count_if(is_delayed = 1) AS Delayed, count_if(is_delayed = 0) AS On_time
FROM featured WHERE sub_category IN (
  SELECT sub_category FROM featured WHERE sub_category IS NOT NULL GROUP BY sub_category
  ORDER BY count(*) DESC, sub_category LIMIT 10) AND is_delayed IS NOT NULL GROUP BY sub_category"""))
def _status_by_top_sub_categories(spark, sf_dir):
    """A15 where the busiest 10 cut (12 sub-categories)."""
    return R.status_by_top_categories(featured(spark, sf_dir), "sub_category")


@register("top_delay_rate_cities", _fsql(f"""
SELECT {_CITY}, avg(is_delayed) AS delayed_rate FROM featured WHERE {_CITY} IS NOT NULL
GROUP BY {_CITY} ORDER BY delayed_rate DESC, {_CITY} LIMIT 10""", ["delayed_rate"]))
def _top_delay_rate_cities(spark, sf_dir):
    """A16 where the top 10 cuts."""
    return R.top_delay_rate_categories(featured(spark, sf_dir), _CITY)


@register("keyword_remarks", with_stage("cleaned", """
SELECT unique_id, CAST(contains(lower(coalesce(customer_remarks, 'nan')), 'licensed')
  OR contains(lower(coalesce(customer_remarks, 'nan')), 'worthless') AS INTEGER) AS has_keywords FROM cleaned"""))
def _keyword_remarks(spark, sf_dir):
    """F7 with keywords that the remarks hold."""
    return delay_stages(spark, sf_dir).clean.select(
        S.UNIQUE_ID, contains_any(S.REMARKS, ["Licensed", "worthless"]).alias("has_keywords"))


_TEXT_TIMES = "strptime(strftime({c}, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S') AS {c}"


@register("parsed_text_times", with_stage("tickets", "SELECT unique_id, " + ", ".join(
    _TEXT_TIMES.format(c=c) for c in TW.DATETIME_COLS) + " FROM tickets"))
def _parsed_text_times(spark, sf_dir):
    """C1 on text: ticket times written day first and parsed back with a list of patterns."""
    text = raw(spark, sf_dir).select(S.UNIQUE_ID, *[F.date_format(c, "dd/MM/yyyy HH:mm:ss").alias(c) for c in S.DATETIME_COLS])
    return convert_datetimes(text, formats=["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"])


# the notation of each text column, as (Java pattern, DuckDB format) of its rows
_WRITTEN = {"order_date_time": ("dd.MM.yyyy", "%d.%m.%Y"), "issue_reported_at": ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"),
            "issue_responded": ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"), "survey_response_date": ("yyyy-MM-dd", "%Y-%m-%d")}
_SQL_FORMAT = {"yyyy": "%Y", "M": "%m", "d": "%d", "H": "%H", "mm": "%M", "ss": "%S"}


def _duck_format(pattern: str) -> str:
    return re.sub("yyyy|mm|ss|[MdH]", lambda m: _SQL_FORMAT[m[0]], pattern)


_votes = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {j} AS pos, '{p}' AS pattern, '{SWAPPED.get(p, '')}' AS swapped, count(w.{c}) AS texts, "
    f"count(try_strptime(w.{c}, '{_duck_format(p)}')) AS parsed FROM w" for c in _WRITTEN for j, p in enumerate(CANDIDATES))


@register("inferred_time_formats", with_stage("tickets", """
SELECT b.column_name, CASE WHEN b.parsed > 0 THEN b.pattern END AS pattern, b.texts, b.parsed,
  coalesce(b.parsed > 0 AND s.parsed = b.parsed, false) AS ambiguous
FROM (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY parsed DESC, pos) = 1) b
LEFT JOIN votes s ON s.column_name = b.column_name AND s.pattern = b.swapped""", "w AS (SELECT " + ", ".join(
    f"CASE WHEN length(unique_id) = 4 AND unique_id LIKE '%7' THEN strftime({c}, '%d-%m-%Y') ELSE strftime({c}, '{f}') END AS {c}"
    for c, (_, f) in _WRITTEN.items()) + " FROM tickets), votes AS (" + _votes + ")"))
def _inferred_time_formats(spark, sf_dir):
    """The voted pattern of four text columns in four notations, some rows of each in a fifth."""
    odd = (F.length(S.UNIQUE_ID) == 4) & F.col(S.UNIQUE_ID).like("%7")
    text = raw(spark, sf_dir).select(*[F.when(odd, F.date_format(c, "dd-MM-yyyy")).otherwise(F.date_format(c, p)).alias(c)
                                       for c, (p, _) in _WRITTEN.items()])
    return infer_formats(text, list(_WRITTEN))


# columns of an export as text: whole numbers, decimals, truth values with and without gaps, texts, numbers with one odd text
_EXPORT = {"whole": "csat_score + 0", "price": "CAST(item_price * 4 AS BIGINT) || '.5'",
           "flag": "CASE WHEN unique_id LIKE '%3' THEN 'True' ELSE 'False' END",
           "gappy.flag": "CASE WHEN csat_score IS NOT NULL AND unique_id NOT LIKE '%4' THEN 'true' END",
           "city": "customer_city", "mixed": "CASE WHEN unique_id = '7' THEN '1e400x' ELSE '17' END",
           "big": "'9' || lpad(unique_id, 19, '0')"}
_WHOLE, _REAL = r"[ \t]*[+-]?[0-9]+[ \t]*", r"[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*"
_ladder = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total, count(v) AS texts, count_if(v IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) AS booleans, "
    f"count(CASE WHEN regexp_full_match(v, '{_WHOLE}') THEN TRY_CAST(v AS BIGINT) END) AS integers, "
    f"count_if(regexp_full_match(v, '{_REAL}') OR regexp_full_match(lower(v), '[+-]?inf(inity)?')) AS doubles "
    f"FROM (SELECT CAST({sql} AS VARCHAR) AS v FROM tickets)" for c, sql in _EXPORT.items())


@register("inferred_types", with_stage("tickets", """
SELECT column_name, CASE WHEN texts > 0 AND booleans = total THEN 'boolean' WHEN texts > 0 AND integers = texts THEN 'bigint'
  WHEN doubles = texts THEN 'double' ELSE 'string' END AS type, texts, total - texts AS missing, booleans, integers, doubles
FROM ladder""", "ladder AS (" + _ladder + ")"))
def _inferred_types(spark, sf_dir):
    """The inferred types of seven text columns (one name with a dot)."""
    return infer_types(raw(spark, sf_dir).select(*[F.expr(e).cast("string").alias(c) for c, e in _EXPORT.items()]))


@register("quality_record", with_stage("tickets", "SELECT total_rows, duplicates, missing FROM ("
          "SELECT count(*) AS total_rows, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tickets)) AS BIGINT) AS duplicates, "
          + " || ',' || ".join(f"'{c}=' || CAST(count_if({c} IS NULL) AS VARCHAR)" for c in _RAW_COLS) + " AS missing FROM tickets)"))
def _quality_record(spark, sf_dir):
    """Q5: the quality record; its map of missing values as text."""
    rec = Q.quality_record(raw(spark, sf_dir))
    pairs = [F.concat(F.lit(f"{c}="), F.col("missing_values")[c].cast("string")) for c in _RAW_COLS]
    return rec.select("total_rows", "duplicates", F.concat_ws(",", *pairs).alias("missing"))


# ---------------------------------------------------------------- statistics
from ticketlens.operators import stats as ST  # noqa: E402
from ticketlens.operators.clean import clean_data, outlier_bounds  # noqa: E402


@register("resolution_histogram", rounded_sql(
    with_stage("featured", TW.histogram_body(), TW.histogram_sql("resolution_time_hours")),
    ["bin_start", "bin_end"]))
def _resolution_histogram(spark, sf_dir):
    """Histogram of resolution hours with numpy's automatic bin rule."""
    return ST.histogram(featured(spark, sf_dir), "resolution_time_hours")


_HIST_CTES, _HIST_BODY = TW.histograms_sql(TW.NUMERIC_FEATURES[:5])


@register("distribution_histograms", rounded_sql(with_stage("featured", _HIST_BODY, _HIST_CTES),
                                                 ["bin_start", "bin_end"]))
def _distribution_histograms(spark, sf_dir):
    """A21 (numeric part): automatic-bin histograms of the first five numeric features."""
    st = delay_stages(spark, sf_dir)
    return ST.histograms(st.featured_rows, st.info.numerical_columns[:5])


_RUN_CTES = _HIST_CTES + "".join(
    f", h{i}_o AS (SELECT bin, cnt, lead(bin) OVER (ORDER BY bin) AS nxt FROM h{i}_c)" for i in range(5))
_RUN_BODY = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(r.bin AS BIGINT) AS bin, CAST(r.bins AS BIGINT) AS bins, f + r.bin * ((l - f) / nb) AS bin_start, "
    f"f + (r.bin + r.bins) * ((l - f) / nb) AS bin_end, CAST(r.cnt AS BIGINT) AS count FROM (SELECT bin, 1 AS bins, cnt FROM h{i}_o "
    f"UNION ALL SELECT bin + 1, nxt - bin - 1, 0 FROM h{i}_o WHERE nxt > bin + 1) r, h{i}_b" for i, c in enumerate(TW.NUMERIC_FEATURES[:5]))


@register("histogram_runs", rounded_sql(with_stage("featured", _RUN_BODY, _RUN_CTES), ["bin_start", "bin_end"]))
def _histogram_runs(spark, sf_dir):
    """The same histograms with runs of empty bins as one row each."""
    st = delay_stages(spark, sf_dir)
    return ST.histogram_runs(st.featured_rows, st.info.numerical_columns[:5])


@register("resolution_kde", rounded_sql(with_stage(
    "featured", f"SELECT point, x, density FROM ({TW.kde_body(['resolution_time_hours'])})"), ["x", "density"]))
def _resolution_kde(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth) of resolution hours on 200 points over its range."""
    return ST.kde(featured(spark, sf_dir), "resolution_time_hours", curve=False).select("point", "x", "density")


@register("distribution_kdes", rounded_sql(with_stage("featured", TW.kde_body(TW.NUMERIC_FEATURES[:5])), ["x", "density"]))
def _distribution_kdes(spark, sf_dir):
    """A21 (curves): the KDE of each of the first five numeric features."""
    st = delay_stages(spark, sf_dir)
    return ST.kdes(st.featured_rows, st.info.numerical_columns[:5], curve=False).drop("curve")


@register("feature_correlations", rounded_sql(
    with_stage("featured", TW.correlation_body(), TW.correlation_sql()), ["correlation"]))
def _feature_correlations(spark, sf_dir):
    """Pairwise-complete Pearson correlation of every model feature."""
    st = delay_stages(spark, sf_dir)
    return ST.correlation_matrix(st.featured_rows, st.info.feature_columns)


_out_union = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_bound, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_bound, "
    f"(SELECT count_if({c} < q1 - 1.5::DOUBLE * (q3 - q1) OR {c} > q3 + 1.5::DOUBLE * (q3 - q1)) FROM cleaned) AS outliers "
    f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM cleaned)"
    for c in TW.CAP_COLS)


@register("outlier_report", rounded_sql(with_stage("cleaned", _out_union), ["lower_bound", "upper_bound"]))
def _outlier_report(spark, sf_dir):
    """IQR bounds and outlier count per examined column."""
    counts, bounds = outlier_bounds(delay_stages(spark, sf_dir).clean_rows)
    return spark.createDataFrame([(c, float(lo), float(hi), counts[c]) for c, (lo, hi) in bounds.items()],
                                 "column_name string, lower_bound double, upper_bound double, outliers long")


# ---------------------------------------------------------------- model data
from ticketlens.ml import metrics as MT  # noqa: E402
from ticketlens.ml.prep import random_split, stratified_split  # noqa: E402
from ticketlens.sources.tickets import scored  # noqa: E402


_QUOTA = """
keyed AS (SELECT unique_id, {label} AS lab, row_number() OVER (PARTITION BY {label}
            ORDER BY substr(md5(coalesce(unique_id, '') || '|42'), 1, 13), md5(coalesce(unique_id, '')), unique_id) AS rn FROM {src}),
tot AS (SELECT ceil({size}::DOUBLE * count(*)) AS total, count(*) AS n FROM keyed),
per AS (SELECT lab, total * count(*) / n AS share, floor(total * count(*) / n) AS low, total FROM keyed, tot GROUP BY lab, total, n),
quota AS (SELECT lab, low + CASE WHEN row_number() OVER (ORDER BY share - low DESC, lab) <= total - sum(low) OVER () THEN 1 ELSE 0 END AS q FROM per)"""


@register("train_test_split", with_stage("featured", """
SELECT unique_id, lab AS is_delayed, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split
FROM keyed JOIN quota USING (lab)""", _QUOTA.format(label="is_delayed", size="0.25", src="featured")))
def _train_test_split(spark, sf_dir):
    """M2: stratified 75/25 split by hash order, exact quota per class."""
    return stratified_split(featured(spark, sf_dir), S.TARGET, 0.25, 42).select(S.UNIQUE_ID, S.TARGET, "split")


@register("random_split", with_stage("cleaned", """
SELECT unique_id, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS split
FROM keyed JOIN quota USING (lab)""", _QUOTA.format(label="0", size="0.2", src="cleaned")))
def _random_split(spark, sf_dir):
    """M1: unstratified 80/20 split by hash order, exact size."""
    return random_split(delay_stages(spark, sf_dir).clean_rows.drop(S.HELD), 0.2, 42).select(S.UNIQUE_ID, "split")


def _ssql(body: str, doubles: list[str] = ()) -> str:
    return rounded_sql(with_stage("scored", body, TW.PER_CLASS_SQL), list(doubles))


@register("confusion_matrix", _ssql("SELECT label, prediction, count(*) AS count FROM scored GROUP BY ALL"))
def _confusion(spark, sf_dir):
    """Confusion counts of the deterministic scored table."""
    return MT.confusion(scored(spark, sf_dir))


@register("classification_metrics", _ssql("""
SELECT sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1,
  (SELECT auc FROM auc) AS auc FROM pf""", ["accuracy", "precision", "recall", "f1", "auc"]))
def _classification_metrics(spark, sf_dir):
    """Accuracy, weighted precision / recall / F1 and AUC."""
    return MT.classification_metrics(scored(spark, sf_dir))


@register("classification_report", _ssql("""
SELECT CAST(class AS VARCHAR) AS row, precision, recall, f1, CAST(support AS BIGINT) AS support FROM pf WHERE support > 0
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
  CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'macro avg', avg(precision) FILTER (WHERE support > 0), avg(recall) FILTER (WHERE support > 0),
  avg(f1) FILTER (WHERE support > 0), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pf""", ["precision", "recall", "f1"]))
def _classification_report(spark, sf_dir):
    """Per-class precision / recall / F1 / support and summary rows."""
    return MT.classification_report(scored(spark, sf_dir))


@register("roc_curve", _ssql("""
SELECT threshold, fpr, tpr FROM (
  SELECT score AS threshold, cum_neg / (SELECT sum(neg) FROM sc) AS fpr, cum_pos / (SELECT sum(pos) FROM sc) AS tpr,
    score = (SELECT max(score) FROM sc) OR score = (SELECT min(score) FROM sc)
      OR lead(pos) OVER (ORDER BY score DESC) <> pos OR lead(neg) OVER (ORDER BY score DESC) <> neg AS keep
  FROM cum) WHERE keep
UNION ALL SELECT (SELECT max(score) FROM sc) + 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    ["threshold", "fpr", "tpr"]))
def _roc_curve(spark, sf_dir):
    """ROC points with collinear points dropped, plus the origin."""
    return MT.roc_curve(scored(spark, sf_dir))


@register("roc_auc", _ssql("SELECT auc FROM auc", ["auc"]))
def _roc_auc(spark, sf_dir):
    """Exact ROC AUC with ties."""
    return MT.roc_auc(scored(spark, sf_dir))


# ---------------------------------------------------------------- model data, prepared
from ticketlens.ml.compare import best_model, comparison_table, melt, rank_by_accuracy  # noqa: E402
from ticketlens.ml.folds import fold_statistics, with_folds  # noqa: E402
from ticketlens.ml.prep import fit_categorical_fill, fit_numeric_prep, fill_stage, one_hot_stages  # noqa: E402

_NUM, _TXT = ["item_price", "connected_handling_time", "response_time_minutes"], ["category", "sub_category", "customer_city"]
_dedup_split = _QUOTA.format(label="0", size="0.2", src="dedup")


@register("prepared_numeric", rounded_sql(with_stage("dedup", "SELECT d.unique_id, " + ", ".join(
    f"(coalesce({c}, m_{c}) - a_{c}) / s_{c} AS {c}_s" for c in _NUM) + " FROM dedup d, fitted",
    _dedup_split + """,
part AS (SELECT d.* FROM dedup d JOIN (SELECT unique_id FROM keyed JOIN quota USING (lab) WHERE rn > q) USING (unique_id)),
med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _NUM) + """ FROM part),
fitted AS (SELECT """ + ", ".join(
        f"any_value(m_{c}) AS m_{c}, avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in _NUM)
    + " FROM part, med)"), [f"{c}_s" for c in _NUM]))
def _prepared_numeric(spark, sf_dir):
    """M3, M5: numeric columns with gaps, imputed by train medians and scaled by train moments."""
    # the narrow columns are written once: every quantile round and moment pass reads them again
    rows = random_split(materialize(_with_gaps(spark, sf_dir).select(S.UNIQUE_ID, *_NUM), "gaps"), 0.2, 42)
    prep = fit_numeric_prep(rows.where("split = 'train'"), _NUM)
    return prep.stage("_s").transform(rows).select(S.UNIQUE_ID, *[f"{c}_s" for c in _NUM])


def _with_gaps(spark, sf_dir):
    """De-duplicated tickets with their missing values."""
    return drop_duplicate_rows(add_response_time(convert_datetimes(raw(spark, sf_dir))))


@register("fold_statistics", rounded_sql(with_stage("dedup", " UNION ALL ".join(
    f"SELECT {f} AS fold, '{c}' AS feature, any_value(m) AS median, avg(coalesce({c}, m)) AS mean, stddev_pop(coalesce({c}, m)) AS deviation "
    f"FROM dealt, (SELECT quantile_cont({c}, 0.5) AS m FROM dealt WHERE fold <> {f}) WHERE fold <> {f}" for f in range(5) for c in _NUM), """
dealt AS (SELECT *, CAST((row_number() OVER (PARTITION BY csat_score ORDER BY md5(unique_id), unique_id) - 1) % 5 AS INTEGER) AS fold FROM dedup)"""),
    ["median", "mean", "deviation"]))
def _fold_statistics(spark, sf_dir):
    """M3, M5 inside M14: medians, means and deviations that a preparation refitted without each of five stratified folds has."""
    gaps = materialize(_with_gaps(spark, sf_dir).select(S.UNIQUE_ID, S.CSAT, *_NUM), "gaps")     # the folds read it twice
    dealt = materialize(with_folds(gaps, 5, S.UNIQUE_ID, S.CSAT), "fold_statistics")
    out = fold_statistics(dealt, _NUM, 5)
    release(gaps, dealt)
    return out


_onehot = " UNION ALL ".join(
    f"SELECT '{c}_' || v AS feature, CAST(count_if(coalesce({c}, f.{c}_mode) = v) AS DOUBLE) AS ones "
    f"FROM dedup, fills f, (SELECT DISTINCT coalesce({c}, (SELECT {c}_mode FROM fills)) AS v FROM part) GROUP BY v" for c in _TXT)


@register("prepared_one_hot", with_stage("dedup", _onehot, _dedup_split + """,
part AS (SELECT d.* FROM dedup d JOIN (SELECT unique_id FROM keyed JOIN quota USING (lab) WHERE rn > q) USING (unique_id)),
fills AS (SELECT """ + ", ".join(
    f"(SELECT {c} FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}_mode" for c in _TXT) + ")"))
def _prepared_one_hot(spark, sf_dir):
    """M4, M6, M7: text columns filled with the train mode, one-hot coded and assembled; ones per feature over all rows."""
    rows = random_split(materialize(_with_gaps(spark, sf_dir).select(S.UNIQUE_ID, *_TXT), "gaps"), 0.2, 42)
    train = rows.where("split = 'train'")
    fitted = Pipeline(stages=[fill_stage(fit_categorical_fill(train, _TXT)), *one_hot_stages(_TXT), VectorAssembler(
        inputCols=[f"{c}_oh" for c in _TXT], outputCol="features")]).fit(train)
    indexer = next(s for s in fitted.stages if isinstance(s, StringIndexerModel))
    names = [f"{c}_{v}" for c, labels in zip(_TXT, indexer.labelsArray) for v in labels]
    ones = fitted.transform(rows).select(F.posexplode(vector_to_array("features")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("ones"))
    named = spark.createDataFrame(list(enumerate(names)), "i int, feature string")
    return ones.join(named, "i").select("feature", "ones")


# three scorers of the labelled documents; the first two always tie
_CUTS = [("first", 0.1), ("second", 0.1), ("third", 0.3)]
_cut_rows = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {i} AS position, avg(CAST(label = CAST(score > {c}::DOUBLE AS BIGINT) AS INTEGER)) AS accuracy FROM scored"
    for i, (m, c) in enumerate(_CUTS))


def _cut_metrics(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return [(m, MT.classification_metrics(rows.withColumn("prediction", (F.col("score") > c).cast("long"))).first().asDict())
            for m, c in _CUTS]


@register("scorer_ranking", rounded_sql(with_stage("scored", f"""
SELECT model, accuracy, CAST(row_number() OVER (ORDER BY accuracy DESC, position) AS INTEGER) AS rank,
  (SELECT model FROM ({_cut_rows}) ORDER BY accuracy DESC, position LIMIT 1) AS best_model,
  (SELECT model FROM ({_cut_rows}) ORDER BY accuracy, position DESC LIMIT 1) AS worst_model,
  max(accuracy) OVER () - min(accuracy) OVER () AS gap FROM ({_cut_rows})"""), ["accuracy", "gap"]))
def _scorer_ranking(spark, sf_dir):
    """Three scorers ranked by accuracy, ties in the given order."""
    ranked, verdict = rank_by_accuracy(spark, [(m, r["accuracy"], 0.0) for m, r in _cut_metrics(spark, sf_dir)])
    v = verdict.first()
    return ranked.drop("runtime").withColumns({k: F.lit(v[k]) for k in ("best_model", "worst_model", "gap")})


@register("scorer_comparison", rounded_sql(with_stage("scored", f"""
SELECT model AS "Model", accuracy, 'auc' AS best_metric, 'first' AS best_model FROM ({_cut_rows})"""), ["accuracy"]))
def _scorer_comparison(spark, sf_dir):
    """Best of three scorers (equal AUC: the first wins)."""
    table = comparison_table(spark, _cut_metrics(spark, sf_dir))
    best = best_model(table).first()
    return table.select("Model", "accuracy", F.lit(best["best_metric"]).alias("best_metric"), F.lit(best["Model"]).alias("best_model"))


@register("scorer_comparison_long", rounded_sql(with_stage("scored", f"""
SELECT model AS "Model", 'accuracy' AS "Metric", accuracy AS "Score" FROM ({_cut_rows})"""), ["Score"]))
def _scorer_comparison_long(spark, sf_dir):
    """The comparison in long form (its accuracy rows)."""
    return melt(comparison_table(spark, _cut_metrics(spark, sf_dir))).where("Metric = 'accuracy'")


# ---------------------------------------------------------------- models (no SQL twin: fitted models)
from ticketlens.ml.logistic import grid_points  # noqa: E402
from ticketlens.ml.train import REFERENCE_GRIDS, feature_importance, search_forest, tune_logistic  # noqa: E402
from ticketlens.plans import models as MD  # noqa: E402

_DATA_CACHE: dict[int, tuple] = {}       # training data by the stages it comes from; one entry
_MODEL_CACHE: dict[int, tuple] = {}      # by the stages they were fitted on; one entry


def _delay_data(spark, sf_dir):
    st = delay_stages(spark, sf_dir)
    if id(st) not in _DATA_CACHE:
        _DATA_CACHE.clear()
        _DATA_CACHE[id(st)] = (MD.prepare_training_data(st.featured_rows, st.info), st)
    return _DATA_CACHE[id(st)][0]


def _delay_models(spark, sf_dir):
    st = delay_stages(spark, sf_dir)
    if id(st) not in _MODEL_CACHE:
        data = _delay_data(spark, sf_dir)
        _MODEL_CACHE.clear()
        _MODEL_CACHE[id(st)] = (data, *MD.run_delay_models(data, tune=False, cv=0), st)
    return _MODEL_CACHE[id(st)][:4]


@register("delay_model_comparison")
def _delay_model_comparison(spark, sf_dir):
    """LR / RF / boosted trees on the delay target, compared."""
    _, _, table, _ = _delay_models(spark, sf_dir)
    return table


@register("delay_model_comparison_long")
def _delay_model_comparison_long(spark, sf_dir):
    """The comparison table in long form (Model, Metric, Score)."""
    _, _, table, _ = _delay_models(spark, sf_dir)
    return melt(table)


@register("delay_feature_importance")
def _delay_feature_importance(spark, sf_dir):
    """Top-15 features of the random forest."""
    data, _, _, results = _delay_models(spark, sf_dir)
    return feature_importance(results["random_forest"].model, data.feature_names, 15, spark)


def _tuned_logistic(spark, sf_dir, tune):
    data = _delay_data(spark, sf_dir)
    return tune_logistic(data.logistic_table(5), len(data.feature_names), data.test, tune=tune, cv=5)


@register("delay_cross_validation")
def _delay_cross_validation(spark, sf_dir):
    """Five stratified folds of the logistic model on the delay target: mean and deviation of the AUC."""
    r = _tuned_logistic(spark, sf_dir, False)
    return spark.createDataFrame([(5, r.cv_metric_mean, r.cv_metric_std)], "folds int, auc_mean double, auc_std double")


@register("delay_grid_search")
def _delay_grid_search(spark, sf_dir):
    """The logistic model's whole grid (16 points, five stratified folds) on the delay target, every point ranked."""
    found = _tuned_logistic(spark, sf_dir, True).search
    order = sorted(range(len(found.points)), key=lambda i: (-found.mean(i), i))
    rows = [(p["C"], p["penalty"], p["solver"], found.mean(i), found.std(i), order.index(i) + 1) for i, p in enumerate(found.points)]
    return spark.createDataFrame(rows, "C double, penalty string, solver string, auc_mean double, auc_std double, rank int")


@register("delay_forest_search")
def _delay_forest_search(spark, sf_dir):
    """The forest's whole grid (18 points, five stratified folds) on the delay target, every point ranked."""
    data = _delay_data(spark, sf_dir)
    found = search_forest(data.logistic_table(5), len(data.feature_names), grid_points(REFERENCE_GRIDS["random_forest"]), 5)
    order = sorted(range(len(found.points)), key=lambda i: (-found.mean(i), i))
    rows = [(p["n_estimators"], p["max_depth"], p["min_samples_split"], found.mean(i), found.std(i), order.index(i) + 1)
            for i, p in enumerate(found.points)]
    return spark.createDataFrame(rows, "n_estimators int, max_depth int, min_samples_split int, auc_mean double, auc_std double, rank int")


@register("csat_model_ranking")
def _csat_model_ranking(spark, sf_dir):
    """Multiclass satisfaction models ranked by accuracy."""
    clean, _ = clean_data(numbered(raw(spark, sf_dir)), dedup=False)                         # pipeline B has no de-duplication
    ranked, verdict, _ = MD.run_csat_models(MD.csat_training_data(clean))
    v = verdict.first()
    return ranked.drop("runtime").withColumns({"best_model": F.lit(v["best_model"]), "gap": F.lit(v["gap"]),
                                               "small_gap": F.lit(v["small_gap"])})
