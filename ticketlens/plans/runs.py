"""End-to-end runs: the report composite (A22) and the two pipelines.

Each returns a dict of DataFrames (plus small driver-side records); when an
output folder is given, tables are written as parquet, the comparison as a
header CSV and the run record as JSON, as the reference writes its results.
"""

from __future__ import annotations

import datetime
import os
import time

from pyspark.sql import DataFrame, SparkSession

from ticketlens import schema as S
from ticketlens.operators import quality as Q
from ticketlens.operators import reports as R
from ticketlens.operators import stats as ST
from ticketlens.operators.clean import clean_data
from ticketlens.ml.train import save_model
from ticketlens.plans import models as MD
from ticketlens.plans.features import FeatureInfo
from ticketlens.plans.pipelines import delay_stages_from
from ticketlens.session import materialize
from ticketlens.sources import io


PROJECT_NAME = "ticketlens"


def quality_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """Q1-Q6 profile of a loaded table."""
    return {"missing": Q.missing_report(raw), "duplicates": Q.duplicate_report(raw),
            "describe": Q.describe(raw), "top_values": Q.top_values_report(raw),
            "summary": Q.quality_summary(raw), "record": Q.quality_record(raw), "head": Q.head(raw)}


def report_tables(df: DataFrame, info: FeatureInfo | None = None, target: str = S.TARGET) -> dict[str, DataFrame]:
    """Every report table, by name (A21 defaults: first five text and numeric columns)."""
    text = (info.categorical_columns if info else S.string_columns(df))[:5]
    nums = (info.numerical_columns if info else S.numeric_columns(df))[:5]
    feats = info.feature_columns if info else [c for c in S.numeric_columns(df) if c != target]
    out = {"distribution_top_values": R.top_values_many(df, text, 10),
           "distribution_histograms": ST.histogram_runs(df, nums), "distribution_kdes": ST.kdes(df, nums)}
    if "category" in df.columns:
        out["resolution_by_category"] = R.resolution_by_category(df, "category", target)
        out["top_categories"] = R.top_values(df, "category", 10)
        out["status_by_top_categories"] = R.status_by_top_categories(df, "category", target)
        out["top_delay_rate_categories"] = R.top_delay_rate_categories(df, "category", target)
    if S.is_datetime(df, S.REPORTED):
        out.update({"daily_volume": R.daily_volume(df), "hourly_volume": R.hourly_volume(df),
                    "weekday_volume": R.weekday_volume(df), "monthly_volume": R.monthly_volume(df)})
        if target in df.columns:
            out.update({"daily_delay_rate": R.daily_delay_rate(df, target_col=target),
                        "hourly_delay_rate": R.hourly_delay_rate(df, target_col=target),
                        "weekday_delay_rate": R.weekday_delay_rate(df, target_col=target)})
    if "agent_shift" in df.columns:
        out["agent_workload"] = R.agent_workload(df)
        if target in df.columns:
            out.update({"agent_performance": R.agent_performance(df, target_col=target),
                        "best_worst_agents": R.best_worst_agents(df, target_col=target),
                        "workload_vs_performance": R.workload_vs_performance(df, target_col=target)})
    if target in df.columns:
        out["status_counts"] = R.status_counts(df, target)
    out["correlations"] = ST.correlation_matrix(df, feats)
    if "resolution_time_hours" in df.columns:
        out["resolution_histogram"] = ST.histogram_runs(df, ["resolution_time_hours"])
        out["resolution_kde"] = ST.kde(df, "resolution_time_hours")
    return out


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    return {name: io.write_table(df, os.path.join(folder, name)) for name, df in tables.items()}


def _loaded(spark: SparkSession, raw: DataFrame | str) -> DataFrame:
    """A ticket table as given, or the CSV export at a path; NaN as NULL, written once."""
    return materialize(io.nan_to_null(io.read_tickets_csv(spark, raw) if isinstance(raw, str) else raw), "tickets")


def run_delay_pipeline(spark: SparkSession, raw: DataFrame | str, output_dir: str | None = None, *,
                       formats=None, tune: bool = True, cv: int = 5, grids: dict | None = None,
                       drop_leakage: bool = False, max_train_rows: int | None = None, data_file: str | None = None,
                       project_name: str = PROJECT_NAME, kinds=MD.KINDS) -> dict:
    """Profile -> clean -> preprocess -> features -> models -> compare -> reports -> record.

    ``raw`` is a ticket table or the path of a CSV export; ``formats`` names the
    timestamp patterns of text columns (``clean.convert_datetimes``).  Models are
    tuned as in the reference unless ``tune=False, cv=0``.
    """
    t0 = time.time()
    started = datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    data_file = data_file if data_file is not None else (raw if isinstance(raw, str) else "")
    raw = _loaded(spark, raw)
    quality = quality_tables(raw)
    st = delay_stages_from(raw, formats=formats)
    data = MD.prepare_training_data(st.featured, st.info, drop_leakage=drop_leakage)
    best, comparison, results = MD.run_delay_models(data, kinds, tune=tune, cv=cv, grids=grids, max_train_rows=max_train_rows)
    reports = report_tables(st.featured, st.info)
    model_tables = {k: MD.model_tables(r, data.feature_names) for k, r in results.items()}
    best_acc = comparison.where(comparison.Model == best).first()["accuracy"]
    record = io.run_record(
        spark, data_shape=(raw.count(), len(raw.columns)), cleaned_shape=(st.clean.count(), len(st.clean.columns)),
        total_features=st.info.total_features, target_column=st.info.target_column, best_model=best,
        best_model_accuracy=best_acc, execution_time_seconds=time.time() - t0, data_file=data_file,
        project_name=project_name, execution_timestamp=started)
    if output_dir:
        io.write_table(st.featured, os.path.join(output_dir, "processed_data"))
        io.write_comparison(comparison, os.path.join(output_dir, "model_comparison"))
        write_tables(reports, os.path.join(output_dir, "reports"))
        io.write_run_record(record, os.path.join(output_dir, "project_metadata"))
        for kind, r in results.items():
            save_model(data.pipeline(r.model), os.path.join(output_dir, "models", kind))
            write_tables(model_tables[kind], os.path.join(output_dir, "results", kind))
    return {"quality": quality, "clean_stats": st.clean_stats, "featured": st.featured, "info": st.info,
            "comparison": comparison, "best_model": best, "reports": reports, "record": record,
            "models": results, "model_tables": model_tables, "data": data}


def run_csat_pipeline(spark: SparkSession, raw: DataFrame | str, output_dir: str | None = None, *, formats=None,
                      kinds=MD.KINDS, include_issue_hour: bool = True, max_train_rows: int | None = None,
                      params: dict | None = None) -> dict:
    """Clean without de-duplication, satisfaction features, multiclass models, ranking."""
    clean, stats = clean_data(_loaded(spark, raw), formats=formats, dedup=False)
    data = MD.csat_training_data(clean, include_issue_hour=include_issue_hour)
    ranked, verdict, results = MD.run_csat_models(data, kinds, max_train_rows, params)
    model_tables = {k: MD.model_tables(r, data.feature_names, multiclass=True) for k, r in results.items()}
    if output_dir:
        for kind, r in results.items():
            save_model(data.pipeline(r.model), os.path.join(output_dir, "models", kind))
            write_tables(model_tables[kind], os.path.join(output_dir, "results", kind))
    return {"clean_stats": stats, "clean": clean, "ranking": ranked, "verdict": verdict, "models": results,
            "model_tables": model_tables, "data": data}
