"""Ticket-shaped tables derived from the driver's parquet tables.

``tickets`` turns ``events`` (one row per event) joined to ``documents`` (the
remark text) into the 17-column support-ticket layout, with the nulls, bad
time orders and duplicate rows that the cleaning steps exist for.  ``scored``
turns ``labels`` joined to ``documents`` into a (label, score, prediction)
table for metric tests that need no fitted model.

Each builder has a DuckDB twin (``TICKETS_SQL`` / ``SCORED_SQL``) so oracle
queries can start from the same rows.  Everything here is narrow except the
remark join, which Spark plans as a shuffle (or broadcast, when AQE sees a
small ``documents``) on ``doc_id``, salted so rows without a remark key spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: mapping of event kinds and user buckets to ticket attributes ---
CATEGORY_BY_EVENT = {"click": "Technical", "error": "Billing", "purchase": "Shipping",
                     "signup": "Product", "view": "Other"}
CHANNELS = ["Inbound", "Outcall", "Email"]
TENURE_BUCKETS = ["0-30", "31-60", "61-90", ">90", "On Job Training"]
AGENT_SHIFTS = ["Morning", "Evening", "Afternoon", "Night", "Split"]
RARE_SHIFT = "Graveyard"          # given to event_id 100..104 only (5 rows < 10)
RARE_SHIFT_IDS = (100, 104)
NULL_KEY_SALTS = 1024
TICKET_COLUMNS = ["unique_id", "channel_name", "category", "sub_category", "customer_remarks", "order_id", "order_date_time", "issue_reported_at",
                  "issue_responded", "survey_response_date", "customer_city", "product_category", "item_price", "connected_handling_time",
                  "tenure_bucket", "agent_shift", "csat_score"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _null_if(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_tickets(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Derive the raw ticket table (before cleaning)."""
    n = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.col("ts").cast("timestamp_ntz")
    n_docs = documents.select(F.count(F.lit(1))).scalar()

    ev = events.select(
        "event_id", "user_id", "event_type", "value", ts.alias("ts"), k.alias("k"),
        F.when(n % 3 != 0, F.pmod(n, n_docs)).alias("doc_key"))
    # a third of the events carry no remark (NULL key).  A salt joins the key:
    # 0 on both sides for keyed rows (same matches), spread over NULL_KEY_SALTS
    # values for NULL-key rows, which never match but no longer hash into one
    # task of a shuffle join.  One scan of ``events``.
    ev = ev.withColumn("_salt", F.when(F.col("doc_key").isNull(), F.pmod(n, F.lit(NULL_KEY_SALTS)))
                       .otherwise(F.lit(0)))
    docs = documents.select(F.col("doc_id").alias("doc_key"), F.lit(0).alias("_salt"),
                            F.col("text").alias("remark_text"))
    joined = ev.join(docs, ["doc_key", "_salt"], "left")

    category = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_BY_EVENT.items() for x in kv]),
                     F.col("event_type")),
        F.lit("Other"))
    shift = F.when(n.between(*RARE_SHIFT_IDS), F.lit(RARE_SHIFT)).otherwise(
        _pick(AGENT_SHIFTS, F.pmod("user_id", F.lit(5))))
    responded = F.when(n % 50 == 0, F.lit(None)).when(
        n % 37 == 0, F.timestamp_add("MINUTE", F.lit(-1), "ts")).otherwise(
        F.timestamp_add("SECOND", F.floor(F.col("value") * 3600), "ts"))
    ordered = F.when(n % 6 == 0, F.lit(None)).when(
        n % 53 == 0, F.timestamp_add("DAY", F.lit(1), "ts")).otherwise(
        F.timestamp_add("DAY", -F.pmod("k", F.lit(30)), "ts"))

    rows = joined.select(
        n.cast("string").alias("unique_id"),
        _pick(CHANNELS, F.pmod("user_id", F.lit(3))).alias("channel_name"),
        _null_if(n % 41 == 0, category).alias("category"),
        _null_if(n % 43 == 0, F.concat(F.lit("sub"), F.pmod("k", F.lit(12)).cast("string"))).alias("sub_category"),
        F.col("remark_text").alias("customer_remarks"),
        _null_if(n % 5 == 0, (F.col("user_id") * 1000 + F.col("k")).cast("string")).alias("order_id"),
        ordered.alias("order_date_time"),
        F.col("ts").alias("issue_reported_at"),
        responded.alias("issue_responded"),
        F.timestamp_add("DAY", F.lit(1), F.to_date("ts").cast("timestamp_ntz")).alias("survey_response_date"),
        _null_if(n % 4 == 0, F.concat(F.lit("city"), F.pmod("user_id", F.lit(20)).cast("string"))).alias("customer_city"),
        _null_if(n % 5 == 0, F.concat(F.lit("pc"), F.pmod("k", F.lit(9)).cast("string"))).alias("product_category"),
        _null_if(n % 7 == 0, F.col("value") * 100).alias("item_price"),
        F.when(n % 100 == 0, F.col("k") * 10.0).alias("connected_handling_time"),
        _pick(TENURE_BUCKETS, F.pmod("user_id", F.lit(5))).alias("tenure_bucket"),
        shift.alias("agent_shift"),
        (1 + F.pmod("k", F.lit(5))).alias("csat_score"),
        # every 97th event is exported twice: a full-row duplicate, made by a
        # narrow explode instead of a second scan + union
        F.explode(F.array_repeat(F.lit(0), F.when(n % 97 == 0, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


def numbered_texts(documents: DataFrame) -> DataFrame:
    """The documents' ids and texts with a number, ``_place``, of their own; to be written before it is used."""
    return documents.select("doc_id", "text", F.monotonically_increasing_id().alias("_place"))


def numbered_tickets(events: DataFrame, texts: DataFrame, row: str, metadata: dict | None = None) -> DataFrame:
    """The tickets with the place of their remark instead of the remark itself: ``row`` is (number of the row, place).

    ``texts`` is the written ``numbered_texts``.  Every text is then stored once, whatever
    number of tickets show it; ``join_texts`` brings the texts to the rows that are read.
    """
    rows = build_tickets(events, texts.select("doc_id", F.col("_place").alias("text")))
    number = F.struct(F.monotonically_increasing_id().alias("n"), F.col("customer_remarks").alias("text"))
    return rows.withColumn(row, number.alias(row, metadata=metadata or {})).drop("customer_remarks")


def join_texts(df: DataFrame, row: str, texts: DataFrame) -> DataFrame:
    """``df`` with ``_text``, the text at the place that ``row`` names; rows without a place are dealt out by their number."""
    place = F.col(f"{row}.text")
    salted = df.withColumn("_salt", F.when(place.isNull(), F.pmod(F.col(f"{row}.n"), F.lit(NULL_KEY_SALTS))).otherwise(F.lit(0)))
    # the least of two is 0 too, but no constant that the optimiser takes out of the key
    right = texts.select("_place", F.least(F.col("_place"), F.lit(0)).alias("_none"), F.col("text").alias("_text"))
    return salted.join(right, (place == F.col("_place")) & (F.col("_salt") == F.col("_none")), "left").drop("_salt", "_place", "_none")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_tickets(read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "documents"))


def build_scored(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, label, score, prediction): a deterministic classifier output."""
    score = F.least(F.greatest(F.col("n_chars") / 25000.0, F.lit(0.0)), F.lit(1.0))
    return (labels.join(documents.select("doc_id", "n_chars"), "doc_id")
            .select("doc_id", F.col("quality").cast("long").alias("label"), score.alias("score"))
            .withColumn("prediction", (F.col("score") > 0.1).cast("long")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_scored(read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents"))


# DuckDB twins (oracle side).  ``{T}`` placeholders are not used: the driver
# registers the parquet tables as views under their own names.
TICKETS_SQL = """
tickets_base AS (
  SELECT
    e.event_id AS _n,
    CAST(e.event_id AS VARCHAR) AS unique_id,
    CASE e.user_id % 3 WHEN 0 THEN 'Inbound' WHEN 1 THEN 'Outcall' ELSE 'Email' END AS channel_name,
    CASE WHEN e.event_id % 41 = 0 THEN NULL ELSE
      CASE e.event_type WHEN 'click' THEN 'Technical' WHEN 'error' THEN 'Billing'
        WHEN 'purchase' THEN 'Shipping' WHEN 'signup' THEN 'Product' ELSE 'Other' END END AS category,
    CASE WHEN e.event_id % 43 = 0 THEN NULL ELSE 'sub' || CAST(e._k % 12 AS VARCHAR) END AS sub_category,
    d.text AS customer_remarks,
    CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST(e.user_id * 1000 + e._k AS VARCHAR) END AS order_id,
    CASE WHEN e.event_id % 6 = 0 THEN NULL
         WHEN e.event_id % 53 = 0 THEN e.ts + INTERVAL 1 DAY
         ELSE e.ts - to_days(CAST(e._k % 30 AS INTEGER)) END AS order_date_time,
    e.ts AS issue_reported_at,
    CASE WHEN e.event_id % 50 = 0 THEN NULL
         WHEN e.event_id % 37 = 0 THEN e.ts - INTERVAL 1 MINUTE
         ELSE e.ts + to_seconds(CAST(floor(e.value * 3600) AS BIGINT)) END AS issue_responded,
    CAST(CAST(e.ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS survey_response_date,
    CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE 'city' || CAST(e.user_id % 20 AS VARCHAR) END AS customer_city,
    CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE 'pc' || CAST(e._k % 9 AS VARCHAR) END AS product_category,
    CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE e.value * 100 END AS item_price,
    CASE WHEN e.event_id % 100 = 0 THEN CAST(e._k AS DOUBLE) * 10.0 ELSE NULL END AS connected_handling_time,
    CASE e.user_id % 5 WHEN 0 THEN '0-30' WHEN 1 THEN '31-60' WHEN 2 THEN '61-90'
      WHEN 3 THEN '>90' ELSE 'On Job Training' END AS tenure_bucket,
    CASE WHEN e.event_id BETWEEN 100 AND 104 THEN 'Graveyard' ELSE
      CASE e.user_id % 5 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Evening' WHEN 2 THEN 'Afternoon'
        WHEN 3 THEN 'Night' ELSE 'Split' END END AS agent_shift,
    CAST(1 + e._k % 5 AS BIGINT) AS csat_score
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS _k FROM events) e
  LEFT JOIN documents d
    ON e.event_id % 3 <> 0 AND d.doc_id = e.event_id % (SELECT count(*) FROM documents)
),
tickets AS (
  SELECT * EXCLUDE (_n) FROM tickets_base
  UNION ALL
  SELECT * EXCLUDE (_n) FROM tickets_base WHERE _n % 97 = 0
)"""

SCORED_SQL = """
scored AS (
  SELECT l.doc_id, CAST(l.quality AS BIGINT) AS label,
         least(greatest(CAST(d.n_chars AS DOUBLE) / 25000.0, 0.0::DOUBLE), 1.0::DOUBLE) AS score,
         CAST(least(greatest(CAST(d.n_chars AS DOUBLE) / 25000.0, 0.0::DOUBLE), 1.0::DOUBLE) > 0.1 AS BIGINT) AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""
