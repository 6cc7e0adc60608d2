"""Row-wise feature steps (all narrow: one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens import schema as S
from ticketlens.functions import (
    clip_lower, combined, complexity, contains_any, datetime_parts, days_between, flag,
    has_remarks_flag, hours_between, status_label, text_length, weekday_name)
from ticketlens.functions.text import URGENT_KEYWORDS


def extract_datetime_features(df: DataFrame, cols: list[str] = S.DATETIME_COLS) -> DataFrame:
    """six calendar columns per timestamp column present."""
    exprs = {}
    for c in cols:
        if S.is_datetime(df, c):
            exprs.update(datetime_parts(c))
    return df.withColumns(exprs) if exprs else df


def create_time_based_features(df: DataFrame) -> DataFrame:
    """ticket age in days and resolution time in hours, clipped at 0."""
    exprs = {}
    if S.is_datetime(df, S.ORDER_TS) and S.is_datetime(df, S.REPORTED):
        exprs["ticket_age_days"] = clip_lower(days_between(S.ORDER_TS, S.REPORTED), 0.0)
    if S.is_datetime(df, S.REPORTED) and S.is_datetime(df, S.RESPONDED):
        exprs["resolution_time_hours"] = clip_lower(hours_between(S.REPORTED, S.RESPONDED), 0.0)
    return df.withColumns(exprs) if exprs else df


def create_category_features(df: DataFrame) -> DataFrame:
    """combined category text and the complexity score."""
    exprs = {}
    if "category" in df.columns and "sub_category" in df.columns:
        exprs["combined_category"] = combined("category", "sub_category")
    if "category" in df.columns:
        exprs["issue_complexity"] = complexity("category")
    return df.withColumns(exprs) if exprs else df


def create_text_based_features(df: DataFrame, keywords: list[str] = URGENT_KEYWORDS) -> DataFrame:
    """remark length and urgency flag."""
    if S.HELD in df.columns and list(keywords) == list(URGENT_KEYWORDS):
        return df.withColumns({c: F.col(f"{S.HELD}.{c}") for c in ("remarks_length", "has_urgent_keywords")})
    if S.REMARKS not in df.columns:
        return df
    return df.withColumns({"remarks_length": text_length(S.REMARKS),
                           "has_urgent_keywords": contains_any(S.REMARKS, keywords)})


def create_target_variable(df: DataFrame, target_col: str = S.TARGET,
                           threshold_hours: float = 24.0) -> tuple[DataFrame, str]:
    """F8: 1 when resolution time exceeds the threshold (strictly), else 0."""
    if "resolution_time_hours" in df.columns:
        return df.withColumn(target_col, flag(F.col("resolution_time_hours") > threshold_hours)), target_col
    if target_col in df.columns:
        return df, target_col
    raise ValueError("No suitable target variable found")


def add_csat_features(df: DataFrame) -> DataFrame:
    """Weekday name and hour of the report, remark presence flag."""
    exprs = {}
    if S.REPORTED in df.columns:
        exprs["issue_day_of_week"] = weekday_name(S.REPORTED)
        exprs["issue_hour"] = F.hour(S.REPORTED)
    if S.REMARKS in df.columns:
        exprs["has_customer_remarks"] = has_remarks_flag(S.REMARKS)
    elif S.HELD in df.columns:
        exprs["has_customer_remarks"] = F.col(f"{S.HELD}.has_customer_remarks")
    return df.withColumns(exprs) if exprs else df
