"""the feature composite, in the reference order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ticketlens import schema as S
from ticketlens.operators import features as FE
from ticketlens.operators.encode import encode_categorical_features


@dataclass
class FeatureInfo:
    target_column: str
    categorical_columns: list[str]
    numerical_columns: list[str]
    feature_columns: list[str] = field(default_factory=list)
    total_features: int = 0


def engineer_features(df: DataFrame, create_target: bool = True, target_col: str = S.TARGET,
                      threshold_hours: float = 24.0) -> tuple[DataFrame, FeatureInfo]:
    df = FE.extract_datetime_features(df)
    df = FE.create_time_based_features(df)
    df = FE.create_category_features(df)
    df = FE.create_text_based_features(df)
    if create_target:
        df, target_col = FE.create_target_variable(df, target_col, threshold_hours)
    df, cats, nums, _ = encode_categorical_features(df, target_col)
    info = FeatureInfo(target_col, cats, nums, nums + [f"{c}_encoded" for c in cats],
                       len(nums) + len(cats))
    return df, info
