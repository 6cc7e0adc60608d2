"""The vote parses a text only by candidates of its separators and counts as if all had tried."""
from pyspark.sql import functions as F

from ticketlens.operators.formats import CANDIDATES, KNOWN, infer_formats, parsed_by, separators


def test_guarded_votes_equal_plain_ones(spark):
    texts = ["2024-01-31 9:05:00", "2024-1-31", "31/01/2024 10:00", "02/03/2024", "3.2.2024 1:02", "+12024-1-2", "-0044-1-2", "2024--1-2",
             "2024-01-31T09:05:00", " 2024-01-31", "2024-13-01", "", "x", "1-2", "2024-01-31 9:05 ", "5/-6/2024", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", F.translate("t", "0123456789", ""))
    plain = df.agg(*[F.count(F.try_to_timestamp("t", F.lit(p))) for p in CANDIDATES]).first()
    assert tuple(df.agg(*[F.count(parsed_by(F.col("t"), F.col("s"), p)) for p in CANDIDATES]).first()) == tuple(plain)


def test_each_known_shape_has_few_candidates(spark):
    assert max(sum(separators(p) == k for p in CANDIDATES) for k in KNOWN) == 3      # y-M-d, d-M-y and M-d-y share theirs
    rows = {r["column_name"]: r for r in infer_formats(spark.createDataFrame([("31/01/2024", "2024-01-02")], "a string, `b.c` string"), ["a", "b.c"]).collect()}
    assert rows["a"]["pattern"] == "d/M/yyyy" and rows["b.c"]["pattern"] == "yyyy-M-d"
