import os
import tempfile

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketlens.plans.runs import run_csat_pipeline, run_delay_pipeline
from ticketlens.sources import io
from ticketlens.sources.tickets import tickets
from conftest import SF_SMALL


def test_delay_pipeline_writes_and_reloads(spark):
    out = tempfile.mkdtemp(prefix="tl-run-", dir="/tmp")
    res = run_delay_pipeline(spark, tickets(spark, SF_SMALL), out, kinds=("logistic_regression",), cv=2,
                             grids={"logistic_regression": {"C": [0.1, 1.0], "penalty": ["l2"]}})
    assert res["best_model"] == "Logistic Regression"
    assert {"resolution_by_category", "correlations", "distribution_histograms", "daily_volume"} <= set(res["reports"])
    rec = res["record"].first()
    assert rec.data_shape[1] == 17 and rec.cleaned_data_shape[1] == 18 and rec.total_features == res["info"].total_features
    back = io.load_project_data(spark, os.path.join(out, "processed_data"),
                                comparison_path=os.path.join(out, "model_comparison"),
                                metadata_path=os.path.join(out, "project_metadata"),
                                models_dir=os.path.join(out, "models"))
    assert back.df.count() == res["featured"].count()
    assert back.model_comparison.count() == 1 and back.metadata["target_column"] == "is_delayed"
    assert set(back.model_comparison.columns) == {"Model", "accuracy", "precision", "recall", "f1", "auc"}
    assert back.metadata["project_name"] and back.metadata["execution_timestamp"] and back.unreadable_models == []
    # the saved pipeline scores raw feature rows as the fitted model scored its test table
    model = back.models["logistic_regression"]
    again = model.transform(back.df).select("unique_id", F.col("prediction").alias("p2"), vector_to_array("probability")[1].alias("s2"))
    j = res["models"]["logistic_regression"].predictions.join(again, "unique_id")
    assert j.count() >= res["data"].test.count()
    assert j.where((F.col("prediction") != F.col("p2")) | (F.abs(F.col("score") - F.col("s2")) > 1e-9)).count() == 0
    tables = res["model_tables"]["logistic_regression"]
    assert {"report", "confusion", "roc", "importance"} == set(tables)
    assert tables["importance"].first().feature in res["data"].feature_names
    assert tables["confusion"].agg(F.sum("count")).first()[0] == res["data"].test.count()


def test_delay_pipeline_from_a_csv_path(spark):
    base = tempfile.mkdtemp(prefix="tl-run-", dir="/tmp")
    t = tickets(spark, SF_SMALL).drop("customer_remarks")
    for c in ("issue_reported_at", "issue_responded", "order_date_time", "survey_response_date"):
        t = t.withColumn(c, F.date_format(c, "dd/MM/yyyy HH:mm:ss"))
    io.write_tickets_csv(t, os.path.join(base, "raw"))
    res = run_delay_pipeline(spark, os.path.join(base, "raw"), kinds=("logistic_regression",), tune=False, cv=0)
    late = res["featured"].where("is_delayed = 1").count()
    assert late > 0 and res["record"].first().data_file.endswith("raw")
    # the voted pattern reads what the named one reads
    from ticketlens.plans.pipelines import delay_stages_from
    named = delay_stages_from(io.read_tickets_csv(spark, os.path.join(base, "raw")), formats="dd/MM/yyyy HH:mm:ss").featured
    assert named.where("is_delayed = 1").count() == late
    with pytest.raises(ValueError, match="no timestamp pattern"):
        delay_stages_from(io.read_tickets_csv(spark, os.path.join(base, "raw")), formats="MM-yyyy")


def test_csat_pipeline(spark):
    base = tempfile.mkdtemp(prefix="tl-run-", dir="/tmp")
    small = {"random_forest": {"n_estimators": 5, "max_depth": 4}}
    res = run_csat_pipeline(spark, tickets(spark, SF_SMALL), base, kinds=("logistic_regression", "random_forest"), params=small)
    assert res["ranking"].count() == 2 and res["verdict"].first().best_model in ("Logistic Regression", "Random Forest")
    for kind, tables in res["model_tables"].items():
        assert {"report", "confusion", "importance"} == set(tables)
        assert set(r.feature for r in tables["importance"].collect()) <= set(res["data"].feature_names)
    models = io.load_models(spark, os.path.join(base, "models"))
    from ticketlens.operators.features import add_csat_features
    again = models["random_forest"].transform(add_csat_features(res["clean"])).select("unique_id", F.col("prediction").alias("p2"))
    j = res["models"]["random_forest"].predictions.join(again.distinct(), "unique_id")
    assert j.count() >= res["data"].test.count() and j.where("prediction <> p2").count() == 0
