import datetime as dt

from pyspark.sql import functions as F

from ticketlens.functions import (
    as_text, clip_lower, combined, complexity, contains_any, datetime_parts, flag, has_remarks_flag,
    minutes_between, status_label, text_length)


def test_null_semantics(spark):
    df = spark.createDataFrame([(None, None), (-2.0, "x"), (3.0, "Unknown")], "v double, t string")
    rows = df.select(clip_lower("v", 0.0).alias("c"), flag(F.col("v") > 1).alias("f"),
                     as_text("t").alias("s"), text_length("t").alias("n"),
                     has_remarks_flag("t").alias("h")).collect()
    assert [r.c for r in rows] == [None, 0.0, 3.0]          # clip keeps NULL
    assert [r.f for r in rows] == [0, 0, 1]                 # NULL comparison -> 0
    assert [r.s for r in rows] == ["nan", "x", "Unknown"]
    assert [r.n for r in rows] == [3, 1, 7]
    assert [r.h for r in rows] == [1, 1, 0]                 # only the exact marker gives 0


def test_keywords_and_categories(spark):
    df = spark.createDataFrame([("Need this ASAP",), ("importantly",), ("calm",), (None,)], "t string")
    got = [r[0] for r in df.select(contains_any("t")).collect()]
    assert got == [1, 1, 0, 0]                              # substring, any case, no word boundary
    cat = spark.createDataFrame([("Technical", "a"), ("Billing", None), ("Other", "b"), (None, "c")],
                                "c string, s string")
    rows = cat.select(complexity("c").alias("x"), combined("c", "s").alias("y")).collect()
    assert [r.x for r in rows] == [3, 2, 1, 1]
    assert [r.y for r in rows] == ["Technical - a", "Billing - nan", "Other - b", "nan - c"]
    lab = spark.createDataFrame([(1,), (0,), (None,)], "t int").select(status_label("t")).collect()
    assert [r[0] for r in lab] == ["Delayed", "On-time", None]


def test_datetime_parts_and_diff(spark):
    ts = [dt.datetime(2024, 1, 6, 9, 0), dt.datetime(2024, 1, 8, 17, 59, 59), None]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz")
    parts = datetime_parts("t")
    rows = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert rows[0]["t_day_of_week"] == 5 and rows[0]["t_is_weekend"] == 1   # Saturday, Monday = 0
    assert rows[0]["t_is_business_hours"] == 1                             # weekends not excluded
    assert rows[1]["t_day_of_week"] == 0 and rows[1]["t_is_business_hours"] == 1
    assert rows[2]["t_hour"] is None and rows[2]["t_is_weekend"] == 0 and rows[2]["t_is_business_hours"] == 0
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 1, 30))],
                              "a timestamp_ntz, b timestamp_ntz")
    assert d.select(minutes_between("a", "b")).first()[0] == 1.5         # not truncated
    assert d.select(minutes_between("b", "a")).first()[0] == -1.5        # signed
