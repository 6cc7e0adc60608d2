"""DuckDB formulations of the delay pipeline stages, used as oracles.

``with_stage(stage, body)`` returns ``WITH <ctes up to stage> <body>``.
Stages: tickets -> conv -> dedup -> cleaned -> pre -> featured (and scored).
The SQL is written independently of the Spark code, with its fixed values spelled
out here, so that a wrong constant on one side shows.
"""

from __future__ import annotations

from ticketlens.sources.tickets import SCORED_SQL, TICKETS_SQL

D = "::DOUBLE"
DATETIME_COLS = ["order_date_time", "issue_reported_at", "issue_responded", "survey_response_date"]
MODE_FILLED = ["channel_name", "category", "sub_category", "tenure_bucket", "agent_shift"]
MEDIAN_FILLED = ["item_price", "connected_handling_time"]
UNKNOWN_FILLED = ["customer_city", "product_category", "customer_remarks"]


def _diff(a: str, b: str, unit_micros: str) -> str:
    return f"(CAST(epoch_us({b}) - epoch_us({a}) AS DOUBLE) / {unit_micros}{D})"


def _mode(col: str, src: str = "dedup") -> str:
    return (f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1)")


CONV = f"""
conv AS (
  SELECT *, {_diff('issue_reported_at', 'issue_responded', '60000000.0')} AS response_time_minutes FROM tickets
)"""

DEDUP = """
dedup AS (SELECT DISTINCT * FROM conv)"""

_cleaned_cols = []
for _c in ["unique_id", "channel_name", "category", "sub_category", "customer_remarks", "order_id",
           "order_date_time", "issue_reported_at", "issue_responded", "survey_response_date",
           "customer_city", "product_category", "item_price", "connected_handling_time",
           "tenure_bucket", "agent_shift", "csat_score", "response_time_minutes"]:
    if _c in MODE_FILLED:
        _cleaned_cols.append(f"coalesce({_c}, {_mode(_c)}) AS {_c}")
    elif _c in MEDIAN_FILLED:
        _cleaned_cols.append(f"coalesce({_c}, (SELECT quantile_cont({_c}, 0.5) FROM dedup)) AS {_c}")
    elif _c in UNKNOWN_FILLED:
        _cleaned_cols.append(f"coalesce({_c}, 'Unknown') AS {_c}")
    elif _c == "order_id":
        _cleaned_cols.append(f"coalesce({_c}, 'generated_order_' || CAST(_gen AS VARCHAR)) AS {_c}")
    elif _c == "order_date_time":
        _cleaned_cols.append(f"coalesce({_c}, issue_reported_at) AS {_c}")
    else:
        _cleaned_cols.append(_c)

CLEANED = f"""
numbered AS (
  SELECT *, CASE WHEN order_id IS NULL THEN row_number() OVER (
      PARTITION BY order_id IS NULL
      ORDER BY md5(coalesce(unique_id, '')), unique_id NULLS FIRST) - 1 END AS _gen
  FROM dedup
),
cleaned AS (
  SELECT {', '.join(_cleaned_cols)} FROM numbered
)"""

CAP_COLS = ["item_price", "connected_handling_time", "csat_score", "response_time_minutes"]


def _bound(col: str, which: str) -> str:
    q1 = f"quantile_cont({col}, 0.25)"
    q3 = f"quantile_cont({col}, 0.75)"
    if which == "lo":
        return f"(SELECT {q1} - 1.5{D} * ({q3} - {q1}) FROM cleaned)"
    return f"(SELECT {q3} + 1.5{D} * ({q3} - {q1}) FROM cleaned)"


def _capped(col: str) -> str:
    lo, hi = _bound(col, "lo"), _bound(col, "hi")
    n_out = f"(SELECT count_if({col} < {lo} OR {col} > {hi}) FROM cleaned)"
    return (f"CASE WHEN {n_out} > 0 AND {col} IS NOT NULL "
            f"THEN least(greatest(CAST({col} AS DOUBLE), {lo}), {hi}) "
            f"ELSE CAST({col} AS DOUBLE) END AS {col}")


PRE = f"""
pre AS (
  SELECT * REPLACE ({', '.join(_capped(c) for c in CAP_COLS)},
                    lower(coalesce(customer_remarks, 'nan')) AS customer_remarks)
  FROM cleaned
)"""


def _parts(col: str) -> list[str]:
    h = f"CAST(hour({col}) AS INTEGER)"
    dow = f"CAST(isodow({col}) - 1 AS INTEGER)"
    return [f"{h} AS {col}_hour",
            f"CAST(day({col}) AS INTEGER) AS {col}_day",
            f"{dow} AS {col}_day_of_week",
            f"CAST(month({col}) AS INTEGER) AS {col}_month",
            f"CAST(coalesce({dow} IN (5, 6), false) AS INTEGER) AS {col}_is_weekend",
            f"CAST(coalesce({h} >= 9 AND {h} < 18, false) AS INTEGER) AS {col}_is_business_hours"]


_complexity = "WHEN 'Technical' THEN 3 WHEN 'Billing' THEN 2 WHEN 'Shipping' THEN 2 WHEN 'Product' THEN 1 WHEN 'Account' THEN 1"
_urgent = " OR ".join(f"contains(lower(coalesce(customer_remarks, 'nan')), '{k}')"
                      for k in ["urgent", "immediately", "asap", "emergency", "critical", "important"])

FEAT_BASE = f"""
feat_base AS (
  SELECT *,
    {', '.join(p for c in DATETIME_COLS for p in _parts(c))},
    CASE WHEN order_date_time IS NULL OR issue_reported_at IS NULL THEN NULL
         ELSE greatest({_diff('order_date_time', 'issue_reported_at', '86400000000.0')}, 0.0{D}) END AS ticket_age_days,
    CASE WHEN issue_reported_at IS NULL OR issue_responded IS NULL THEN NULL
         ELSE greatest({_diff('issue_reported_at', 'issue_responded', '3600000000.0')}, 0.0{D}) END AS resolution_time_hours,
    coalesce(category, 'nan') || ' - ' || coalesce(sub_category, 'nan') AS combined_category,
    CAST(CASE category {_complexity} ELSE 1 END AS INTEGER) AS issue_complexity,
    CAST(length(coalesce(customer_remarks, 'nan')) AS INTEGER) AS remarks_length,
    CAST(coalesce({_urgent}, false) AS INTEGER) AS has_urgent_keywords
  FROM pre
)"""

ENCODED_COLS = ["channel_name", "category", "sub_category", "customer_city", "product_category",
                "tenure_bucket", "agent_shift", "combined_category"]

FEATURED = f"""
featured AS (
  SELECT *,
    CAST(coalesce(resolution_time_hours > 24, false) AS INTEGER) AS is_delayed,
    {', '.join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS INTEGER) AS {c}_encoded" for c in ENCODED_COLS)}
  FROM feat_base
)"""

STAGES = {
    "tickets": [TICKETS_SQL],
    "conv": [TICKETS_SQL, CONV],
    "dedup": [TICKETS_SQL, CONV, DEDUP],
    "cleaned": [TICKETS_SQL, CONV, DEDUP, CLEANED],
    "pre": [TICKETS_SQL, CONV, DEDUP, CLEANED, PRE],
    "featured": [TICKETS_SQL, CONV, DEDUP, CLEANED, PRE, FEAT_BASE, FEATURED],
    "scored": [SCORED_SQL],
}


def with_stage(stage: str, body: str, extra: str = "") -> str:
    ctes = ",".join(STAGES[stage]) + (("," + extra) if extra else "")
    return f"WITH {ctes}\n{body}"

_PART_SUFFIXES = ["hour", "day", "day_of_week", "month", "is_weekend", "is_business_hours"]
NUMERIC_FEATURES = (CAP_COLS + [f"{c}_{p}" for c in DATETIME_COLS for p in _PART_SUFFIXES]
                    + ["ticket_age_days", "resolution_time_hours", "issue_complexity", "remarks_length",
                       "has_urgent_keywords"])
CORR_FEATURES = NUMERIC_FEATURES + [f"{c}_encoded" for c in ENCODED_COLS]


def histogram_sql(col: str, src: str = "featured", p: str = "h") -> str:
    """CTEs {p}s, {p}p, {p}b, {p}c: numpy 'auto' bins and counts of one column."""
    one, half, two = "1.0::DOUBLE", "0.5::DOUBLE", "2.0::DOUBLE"
    return f"""
{p}s AS (SELECT count({col}) AS n, CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi,
         quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM {src}),
{p}p AS (SELECT n, CASE WHEN lo = hi THEN lo - {half} ELSE lo END AS f, CASE WHEN lo = hi THEN hi + {half} ELSE hi END AS l,
         (hi - lo) / (log2(n) + {one}) AS sturges, {two} * (q3 - q1) * pow(n, -{one} / 3.0::DOUBLE) AS fd FROM {p}s),
{p}w AS (SELECT *, CASE WHEN fd <> 0 THEN least(fd, sturges) ELSE sturges END AS width FROM {p}p),
{p}b AS (SELECT f, l, CASE WHEN width = 0 THEN 1 ELSE greatest(CAST(ceil((l - f) / width) AS BIGINT), 1) END AS nb
       FROM {p}w),
{p}c AS (SELECT CAST(least(nb - 1, floor((CAST({col} AS DOUBLE) - f) * (nb / (l - f)))) AS INTEGER) AS bin,
         count(*) AS cnt FROM {src}, {p}b WHERE {col} IS NOT NULL GROUP BY 1)"""


def histogram_body(p: str = "h", column: str | None = None) -> str:
    name = f"'{column}' AS column_name, " if column else ""
    return f"""
SELECT {name}CAST(g.i AS INTEGER) AS bin, f + g.i * ((l - f) / nb) AS bin_start,
       f + (g.i + 1) * ((l - f) / nb) AS bin_end, CAST(coalesce({p}c.cnt, 0) AS BIGINT) AS count
FROM (SELECT unnest(range(nb)) AS i, f, l, nb FROM {p}b) g LEFT JOIN {p}c ON {p}c.bin = g.i"""


def histograms_sql(cols: list[str], src: str = "featured") -> tuple[str, str]:
    """(extra CTEs, body) for several columns' histograms, stacked."""
    ctes = ",".join(histogram_sql(c, src, f"h{i}_") for i, c in enumerate(cols))
    body = "\nUNION ALL".join(histogram_body(f"h{i}_", c) for i, c in enumerate(cols))
    return ctes, body


def kde_body(cols: list[str], src: str = "featured", grid: int = 200) -> str:
    """Gaussian KDEs over [min, max], summed over every row."""
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column_name, CAST(p AS INTEGER) AS point, any_value(lo + p * step) AS x,
  sum(exp(-0.5::DOUBLE * pow((lo + p * step - {c}) / bw, 2))) / any_value(n * bw * sqrt(2 * pi())) AS density
FROM {src}, (SELECT *, (hi - lo) / {grid - 1}.0::DOUBLE AS step, sd * pow(n, -0.2::DOUBLE) AS bw FROM (
    SELECT count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, stddev_samp({c}) AS sd FROM {src})) k,
  (SELECT unnest(range({grid})) AS p) pts
WHERE {c} IS NOT NULL AND sd > 0 GROUP BY p""")
    return " UNION ALL ".join(parts)


def correlation_sql(cols: list[str] = None, src: str = "featured") -> str:
    cols = cols or CORR_FEATURES
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = ",\n  ".join(
        f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * "
        f"stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL), 0) AS \"{a}@{b}\"" for a, b in pairs)
    return f"""
corr_wide AS MATERIALIZED (SELECT {aggs} FROM {src}),
corr_long AS (
  SELECT split_part(k, '@', 1) AS feature_x, split_part(k, '@', 2) AS feature_y, v AS correlation
  FROM corr_wide UNPIVOT INCLUDE NULLS (v FOR k IN (COLUMNS(*)))
)"""


def correlation_body() -> str:
    return """
SELECT feature_x, feature_y, correlation FROM corr_long
UNION ALL
SELECT feature_y, feature_x, correlation FROM corr_long WHERE feature_x <> feature_y"""


PER_CLASS_SQL = """
pc AS (
  SELECT c AS class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
  FROM (SELECT label AS c, count(*) AS support, count_if(label = prediction) AS tp FROM scored GROUP BY 1) t
  FULL OUTER JOIN (SELECT prediction AS c, count(*) AS predicted FROM scored GROUP BY 1) p USING (c)
),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0::DOUBLE END AS precision,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0::DOUBLE END AS recall FROM pc),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0.0::DOUBLE END AS f1 FROM pm),
sc AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM scored
       WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
                  sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
        FROM sc),
auc AS (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                    THEN sum(neg * (cum_pos - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) END AS auc FROM cum)"""
