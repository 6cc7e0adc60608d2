import datetime as dt

from pyspark.sql import functions as F

from ticketlens.operators.clean import cap_outliers, clean_data, convert_datetimes, generate_ids, preprocess_data


def test_parse_with_explicit_format(spark):
    df = spark.createDataFrame([("02/01/2024 10:30",), ("31/12/2023 23:59",), ("garbage",), (None,)],
                               "issue_reported_at string")
    out = convert_datetimes(df, formats={"issue_reported_at": "dd/MM/yyyy HH:mm"}).collect()
    assert out[0][0] == dt.datetime(2024, 1, 2, 10, 30)       # day first, as told
    assert out[1][0] == dt.datetime(2023, 12, 31, 23, 59)
    assert out[2][0] is None and out[3][0] is None             # unparsable -> NULL, no error


def _toy(spark):
    rows = [
        ("1", "Technical", None, "o1", dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 2, 9), 10.0, "Hi"),
        ("2", None, "x", None, dt.datetime(2024, 1, 1, 9), None, None, None),
        ("3", "Billing", "x", None, dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 8, 59), 30.0, "URGENT"),
        ("3", "Billing", "x", None, dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 8, 59), 30.0, "URGENT"),
        ("4", "Billing", "y", "o4", None, dt.datetime(2024, 1, 3), 1000.0, None),
    ]
    return spark.createDataFrame(rows, "unique_id string, category string, sub_category string, order_id string, "
                                       "issue_reported_at timestamp_ntz, issue_responded timestamp_ntz, "
                                       "item_price double, customer_remarks string")


def test_clean_fills_and_stats(spark):
    out, stats = clean_data(_toy(spark))
    rows = {r.unique_id: r for r in out.collect()}
    assert len(rows) == 4 and stats["duplicates_removed"] == 1
    assert rows["2"].category == "Billing"                     # mode
    assert rows["1"].sub_category == "x"                       # mode
    assert rows["2"].item_price == 30.0                        # median of 10, 30, 1000
    assert rows["2"].customer_remarks == "Unknown"
    gen = sorted(r.order_id for r in rows.values() if r.order_id.startswith("generated_order_"))
    assert gen == ["generated_order_0", "generated_order_1"]   # dense from 0
    assert rows["3"].response_time_minutes == -1.0            # signed
    assert stats["order_id_generated"] == 2
    assert stats["remaining_missing"] == out.select(
        sum(F.count_if(F.col(c).isNull()) for c in out.columns)).first()[0]


def test_generate_ids_partition_independent(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("unique_id"),
                                 F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("k")).alias("order_id"))
    results = []
    for n in (1, 2, 50):
        out = generate_ids(df.repartition(n))
        results.append(sorted((r.unique_id, r.order_id) for r in out.collect()))
    assert results[0] == results[1] == results[2]
    gen = sorted(int(o.split("_")[-1]) for _, o in results[0] if o.startswith("generated_order_"))
    assert gen == list(range(167))


def test_cap_outliers_constant_after_median(spark):
    vals = [1.0] * 8 + [1.0, 50.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "x double, ticket_id long")
    out, counts, bounds = cap_outliers(df)
    assert "ticket_id" not in bounds                            # names ending in id are skipped
    assert bounds["x"] == (1.0, 1.0) and counts == {"x": 1}
    assert {r.x for r in out.collect()} == {1.0}
    pre = preprocess_data(spark.createDataFrame([("MiXeD",), (None,)], "customer_remarks string"))
    assert [r[0] for r in pre.collect()] == ["mixed", "nan"]


def test_text_times_in_several_patterns(spark):
    import datetime as dt

    import pytest
    from ticketlens.operators.clean import check_parsed, convert_datetimes
    texts = ["01/08/2023 11:13", "2023-08-01 11:13", "2023-08-15", "2023-08-01T11:13:05", None, "nonsense"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, issue_reported_at string")
    out = convert_datetimes(df)
    got = {r.id: r.issue_reported_at for r in out.collect()}
    assert got[1] == dt.datetime(2023, 8, 1, 11, 13) and got[2] == dt.datetime(2023, 8, 15) and got[3] == dt.datetime(2023, 8, 1, 11, 13, 5)
    assert got[0] is None and got[4] is None and check_parsed(df, out) == {"issue_reported_at": 2}
    first = convert_datetimes(df, formats={"issue_reported_at": ["dd/MM/yyyy HH:mm"]})
    assert {r.id: r.issue_reported_at for r in first.collect()}[0] == dt.datetime(2023, 8, 1, 11, 13)
    with pytest.raises(ValueError, match="issue_reported_at"):
        check_parsed(df, convert_datetimes(df, formats="MM-yyyy"))


def test_time_patterns_are_voted(spark):
    """Day first, month first, ambiguous, mixed, missing and unreadable columns; clean_data needs no formats."""
    from ticketlens.operators.formats import infer_formats
    rows = [("01/08/2023 11:13", "08/13/2023 1:05:09", "01/02/2023", "3-4-2023", None, "soon", 1),
            ("15/08/2023 09:00", "1/2/2023 23:59:59", "03/04/2023", "nonsense", None, "", 2),
            (None, "garbage", "12/12/2023", "2023-01-05", None, None, 3), ("2/9/2023 7:30", None, None, "31-12-2023", None, "13", 4)]
    df = spark.createDataFrame(rows, "`a.b` string, m string, both string, mixed string, none string, bad string, n long")
    got = {r.column_name: tuple(r)[1:] for r in infer_formats(df, df.columns).collect()}
    assert got == {"a.b": ("d/M/yyyy H:mm", 3, 3, False), "m": ("M/d/yyyy H:mm:ss", 3, 2, False), "both": ("M/d/yyyy", 3, 3, True),
                   "mixed": ("d-M-yyyy", 4, 2, False), "none": (None, 0, 0, False), "bad": (None, 3, 0, False)}
    assert infer_formats(df, ["n"]).collect() == [] and infer_formats(df.where("false"), ["m"]).first().pattern is None
    export = spark.createDataFrame([("1", "01/08/2023 11:13", "01/08/2023 11:43", "02/03/2023"), ("2", "14/08/2023 10:00", "14/08/2023 10:30", "04/05/2023")],
                                   "unique_id string, issue_reported_at string, issue_responded string, survey_response_date string")
    clean, stats = clean_data(export)
    assert stats["mean_response_time"] == 30.0 and stats["ambiguous_timestamps"] == ["survey_response_date"]
    assert {r.unique_id: r.issue_reported_at for r in clean.collect()}["1"] == dt.datetime(2023, 8, 1, 11, 13)


def test_rows_that_occur_once_are_not_shuffled_and_copies_go(spark):
    from ticketlens.operators.clean import drop_duplicate_rows
    rows = [(i, f"t{i % 50}", float(i % 7)) for i in range(500)] + [(1, "t1", 1.0)] * 300 + [(None, None, None)] * 3 \
        + [(9999, None, float("nan"))] * 2 + [(7777, "z", 0.0), (7777, "z", -0.0)]
    df = spark.createDataFrame(rows, "id long, `a.b` string, _bits double").repartition(5)
    got = drop_duplicate_rows(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.dropDuplicates().collect()))
    assert drop_duplicate_rows(df.where("false")).count() == 0


def test_shared_digest_bits_do_not_drop_rows(spark, monkeypatch):
    from ticketlens.operators import clean
    monkeypatch.setattr(clean, "DIGEST_BITS", 3)               # every row meets a set bit
    df = spark.createDataFrame([(i % 40, i % 40 > 5 and i) for i in range(100)], "a long, b string")
    assert sorted(map(str, clean.drop_duplicate_rows(df).collect())) == sorted(map(str, df.dropDuplicates().collect()))


def test_column_names_with_dots(spark):
    from ticketlens.operators.clean import cap_outliers, clean_data
    from ticketlens.operators.quality import describe, duplicate_report, missing_report, quality_record
    df = spark.createDataFrame([(str(i), "c", None if i == 3 else float(i), f"x{i}") for i in range(8)] + [("0", "c", 0.0, "x0")],
                               "unique_id string, category string, `size.cm` double, `a``b` string")
    assert [(r.column_name, r.missing_values) for r in missing_report(df).collect()] == [("size.cm", 1)]
    assert duplicate_report(df).first().duplicates == 1 and describe(df).first().column_name == "size.cm"
    assert quality_record(df).first().missing_values["size.cm"] == 1
    out, stats = clean_data(df)
    assert stats["duplicates_removed"] == 1 and set(out.columns) == set(df.columns)
    capped, _, bounds = cap_outliers(out)
    assert "size.cm" in bounds and capped.count() == 8
