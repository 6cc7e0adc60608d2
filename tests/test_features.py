import pytest
from pyspark.sql import functions as F

from ticketlens.operators.encode import encode_categorical_features
from ticketlens.operators.features import create_target_variable


def test_label_codes_dense_sorted(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("b", 4.0), ("Z", 5.0)], "c string, v double")
    out, cats, nums, dic = encode_categorical_features(df)
    assert cats == ["c"] and nums == ["v"]
    codes = {r.c: r.c_encoded for r in out.collect()}
    # sorted text values: 'Z' < 'a' < 'b' < 'nan' (code-point order)
    assert codes == {"Z": 0, "a": 1, "b": 2, None: 3}


def test_target_rules(spark):
    df = spark.createDataFrame([(24.0,), (24.5,), (None,)], "resolution_time_hours double")
    out, name = create_target_variable(df, "is_delayed", 24)
    assert [r.is_delayed for r in out.collect()] == [0, 1, 0]   # strict, NULL -> 0
    with pytest.raises(ValueError):
        create_target_variable(spark.range(1), "is_delayed", 24)


def test_featured_invariants(stages):
    f = stages.featured
    info = stages.info
    assert info.total_features == len(info.feature_columns)
    for c in info.categorical_columns:
        n = f.select(F.countDistinct(F.coalesce(F.col(c), F.lit("nan")))).first()[0]
        mn, mx = f.agg(F.min(f"{c}_encoded"), F.max(f"{c}_encoded")).first()
        assert (mn, mx) == (0, n - 1)
    assert f.where(F.col("is_delayed").isNull()).count() == 0
    assert f.where(F.col("ticket_age_days") < 0).count() == 0


def test_codes_are_the_same_on_the_join_path(spark):
    from ticketlens.operators.encode import encode_categorical_features
    rows = [(i, "hot" if i % 2 else f"v{i % 50}", None if i % 4 else f"w{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    key = lambda d: sorted((r.id, r.a_encoded, r.b_encoded) for r in d.collect())
    small, joined = encode_categorical_features(df)[0], encode_categorical_features(df, broadcast_bytes=0)[0]
    assert key(small) == key(joined) and set(small.columns) == set(joined.columns)
    assert key(encode_categorical_features(df, broadcast_bytes=600)[0]) == key(small)
