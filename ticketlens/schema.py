"""Ticket table column names and roles.

Columns are snake_case inside the library; ``RAW_TO_SNAKE`` maps the names of
the original CSV export at the read edge (``sources.io.read_tickets_csv``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: input column names of the ticket export and their internal names ---
RAW_TO_SNAKE = {
    "Unique id": "unique_id",
    "channel_name": "channel_name",
    "category": "category",
    "Sub-category": "sub_category",
    "Customer Remarks": "customer_remarks",
    "Order_id": "order_id",
    "order_date_time": "order_date_time",
    "Issue_reported at": "issue_reported_at",
    "issue_responded": "issue_responded",
    "Survey_response_Date": "survey_response_date",
    "Customer_City": "customer_city",
    "Product_category": "product_category",
    "Item_price": "item_price",
    "connected_handling_time": "connected_handling_time",
    "Tenure Bucket": "tenure_bucket",
    "Agent Shift": "agent_shift",
    "CSAT Score": "csat_score",
}

UNIQUE_ID = "unique_id"
ORDER_ID = "order_id"
REMARKS = "customer_remarks"
ROW = "_row"              # number of a row of a written table, by which its remarks are found again
HELD = "_held"            # struct that stands for remarks set aside (``operators.clean.set_aside``)
REPORTED = "issue_reported_at"
RESPONDED = "issue_responded"
ORDER_TS = "order_date_time"
SURVEY_TS = "survey_response_date"
CSAT = "csat_score"
TARGET = "is_delayed"

# --- fixed values: column groups the cleaning steps act on ---
DATETIME_COLS = [ORDER_TS, REPORTED, RESPONDED, SURVEY_TS]
MODE_FILL_COLS = ["channel_name", "category", "sub_category", "tenure_bucket", "agent_shift"]
MEDIAN_FILL_COLS = ["item_price", "connected_handling_time"]
UNKNOWN_FILL_COLS = ["customer_city", "product_category", REMARKS]
ENCODE_EXCLUDE = [REMARKS, UNIQUE_ID, ORDER_ID]
MODEL_EXCLUDE = [UNIQUE_ID, ORDER_ID, ORDER_TS, REPORTED, RESPONDED, SURVEY_TS, REMARKS]

def quoted(name: str) -> str:
    """A column name as SQL reads it literally, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def is_datetime(df: DataFrame, col: str) -> bool:
    return col in df.columns and isinstance(
        df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType))
