import os
import tempfile

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from ticketlens.sources import io
from ticketlens.sources.tickets import tickets
from conftest import SF_SMALL


def test_csv_roundtrip_with_export_names(spark):
    base = tempfile.mkdtemp(prefix="tl-io-", dir="/tmp")
    t = tickets(spark, SF_SMALL).limit(50).drop("customer_remarks")
    io.write_tickets_csv(t, os.path.join(base, "raw"))
    back = io.read_tickets_csv(spark, os.path.join(base, "raw"))
    assert set(back.columns) == set(t.columns)
    assert dict(back.dtypes)["item_price"] == "double" and dict(back.dtypes)["csat_score"] == "bigint"
    assert back.count() == 50


def test_project_data_fallbacks_and_models(spark):
    base = tempfile.mkdtemp(prefix="tl-io-", dir="/tmp")
    pd_ = io.load_project_data(spark, os.path.join(base, "missing"), None)
    assert pd_.df is None and pd_.model_comparison is None and pd_.metadata is None
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    io.write_table(df, os.path.join(base, "processed"))
    rec = io.run_record(spark, data_shape=(10, 20), cleaned_shape=(9, 21), total_features=44,
                        target_column="is_delayed", best_model="Logistic Regression",
                        best_model_accuracy=1.0, execution_time_seconds=1.234)
    io.write_run_record(rec, os.path.join(base, "meta"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="f")]).fit(df)
    model.write().overwrite().save(os.path.join(base, "models", "assembler"))
    os.makedirs(os.path.join(base, "models", "broken"))
    got = io.load_project_data(spark, os.path.join(base, "processed"), None,
                               metadata_path=os.path.join(base, "meta"), models_dir=os.path.join(base, "models"))
    assert got.df.count() == 1
    assert got.metadata["data_shape"] == [10, 20] and got.metadata["execution_time_seconds"] == 1.23
    assert set(got.models) == {"assembler"}                     # unreadable model skipped


def test_null_markers_and_nan(spark):
    base = tempfile.mkdtemp(prefix="tl-io-", dir="/tmp")
    with open(os.path.join(base, "t.csv"), "w") as f:
        f.write("Unique id,category,Item_price\n1,NA,NaN\n2,null,3.5\n3,N/A,\n4,nanny,inf\n")
    rows = {r.unique_id: r for r in io.read_tickets_csv(spark, os.path.join(base, "t.csv")).collect()}
    assert [rows[k].category for k in "1234"] == [None, None, None, "nanny"]
    assert [rows[k].item_price for k in "123"] == [None, 3.5, None]
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, k int")
    assert [r.x for r in io.nan_to_null(df).collect()] == [None, 2.0]
    from ticketlens.operators.quality import missing_report
    assert {r.column_name: r.missing_values for r in missing_report(df).collect()} == {"x": 1, "k": 1}


def test_types_of_columns_that_the_export_does_not_name(spark):
    base = tempfile.mkdtemp(prefix="tl-io-", dir="/tmp")
    with open(os.path.join(base, "t.csv"), "w") as f:
        f.write("Unique id,Item_price,visits,score.x,vip,gappy,code,empty,huge\n"
                "1,2.5,7,1.5,True,true,A1,,99999999999999999999\n2,bad,,-2e3,False,,17,NA,1\n3,1, 12 ,inf,true,false,8,null,2\n")
    df = io.read_tickets_csv(spark, os.path.join(base, "t.csv"))
    assert dict(df.dtypes) == {"unique_id": "string", "item_price": "double", "visits": "bigint", "score.x": "double", "vip": "boolean",
                               "gappy": "string", "code": "string", "empty": "double", "huge": "double"}
    rows = {r.unique_id: r for r in df.collect()}
    assert [rows[k].visits for k in "123"] == [7, None, 12] and [rows[k].vip for k in "123"] == [True, False, True]
    assert [rows[k]["score.x"] for k in "123"] == [1.5, -2000.0, float("inf")] and rows["2"].item_price is None
    plain = io.read_tickets_csv(spark, os.path.join(base, "t.csv"), infer=False)
    assert dict(plain.dtypes)["visits"] == "string"


def test_types_of_an_empty_table(spark):
    from ticketlens.sources.types import infer_types
    got = infer_types(spark.createDataFrame([], "a string, b int")).collect()
    assert [(r.column_name, r.type, r.texts, r.missing) for r in got] == [("a", "double", 0, 0)]
    assert infer_types(spark.createDataFrame([(1,)], "b int")).count() == 0
