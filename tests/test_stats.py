import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketlens.operators.stats import correlation_matrix, histogram, kde, kde_exact, kdes


def test_histogram_matches_numpy_auto(spark):
    rng = np.random.default_rng(11)
    x = rng.gamma(2.0, 10.0, 5000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    rows = sorted(histogram(df, "x").collect())
    counts, edges = np.histogram(x, bins="auto")
    assert len(rows) == len(counts)
    assert np.allclose([r.bin_start for r in rows], edges[:-1])
    assert sum(r["count"] for r in rows) == len(x)
    assert np.abs(np.array([r["count"] for r in rows]) - counts).sum() <= 2     # edge rounding only


def test_binned_kde_close_to_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 2, 2000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    a = np.array([r.density for r in sorted(kde(df, "x").collect())])
    b = np.array([r.density for r in sorted(kde_exact(df, "x").collect())])
    assert np.max(np.abs(a - b)) < 1e-3 * np.max(b)


def test_correlation_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    n = 400
    a = rng.normal(size=n)
    b = a * 0.5 + rng.normal(size=n)
    c = np.where(rng.random(n) < 0.3, np.nan, b + rng.normal(size=n))
    k = np.full(n, 7.0)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "k": k})
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in pdf.values],
                               "a double, b double, c double, k double").repartition(3)
    got = {(r.feature_x, r.feature_y): r.correlation for r in correlation_matrix(df, list(pdf.columns)).collect()}
    want = pdf.corr()
    for x in "abc":
        for y in "abc":
            assert abs(got[(x, y)] - want.loc[x, y]) < 1e-9
    assert got[("a", "k")] is None and got[("k", "k")] is None     # constant column -> NULL, no error


def test_kde_with_one_far_value_of_a_million(spark):
    df = spark.range(1_000_000).select(F.when(F.col("id") == 5, 1e6).otherwise(F.randn(3)).alias("x"))
    df = df.withColumn("x", F.when(F.col("x") > 1e5, F.lit(1e6)).otherwise(F.col("x"))).persist()
    a = np.array([r.density for r in sorted(kde(df, "x").collect())])
    b = np.array([r.density for r in sorted(kde_exact(df, "x").collect())])
    df.unpersist()
    assert np.max(np.abs(a - b)) < 1e-3 * np.max(b)
    assert abs(a[0] / b[0] - 1) < 1e-3


def test_kde_range_scale_and_empty_columns(spark):
    x = np.random.default_rng(1).gamma(2, 3, 4000)
    df = spark.createDataFrame([(float(v), 1.0, None) for v in x], "x double, k double, z double")
    out = sorted(kde(df, "x").collect())
    assert abs(out[0].x - x.min()) < 1e-9 and abs(out[-1].x - x.max()) < 1e-9
    wide = sorted(kde(df, "x", cut=3.0).collect())
    assert wide[0].x < x.min() and wide[-1].x > x.max()
    edges = np.histogram_bin_edges(x, "auto")
    assert abs(out[7].curve - out[7].density * len(x) * (edges[1] - edges[0])) < 1e-6
    assert kdes(df, ["k", "z"]).count() == 0


def test_correlation_leaves_nan_out(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("nan"), 3.0), (3.0, 1.0, 2.0), (4.0, 5.0, 9.0)], "a double, b double, c double")
    got = {(r.feature_x, r.feature_y): r.correlation for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    want = df.toPandas().corr()
    assert all(abs(got[i, j] - want.loc[i, j]) < 1e-9 for i in "abc" for j in "abc")


def test_histograms_deal_their_bins_over_tasks(spark):
    """Bins of all columns come from one range, not from an array per column, and equal those of single histograms."""
    from ticketlens.operators.stats import histograms
    df = spark.createDataFrame([(float(i % 97), float(i * i), None) for i in range(500)], "a double, b double, c double")
    out = histograms(df, ["a", "c", "b"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Range (0, " in plan
    got = {(r.column_name, r.bin): tuple(r)[2:] for r in out.collect()}
    assert got == {(c, r.bin): tuple(r)[1:] for c in "ab" for r in histogram(df, c).collect()}


def test_histogram_runs_equal_the_listed_bins(spark):
    from ticketlens.operators.stats import histogram_runs, histograms
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.gauss(0, 1), float(rng.choice([1, 2, 90])), None) for _ in range(400)] + [(40.0, None, float("nan"))],
                               "`x.y` double, b double, c double")
    dense = {(r.column_name, r.bin): r for r in histograms(df, ["x.y", "b", "c"]).collect()}
    seen = set()
    for r in histogram_runs(df, ["x.y", "b", "c"]).collect():
        assert (r["count"] > 0) == (r.bins == 1 and r["count"] > 0)
        for i in range(r.bin, r.bin + r.bins):
            d = dense[(r.column_name, i)]
            assert d["count"] == r["count"]
            seen.add((r.column_name, i))
        assert abs(r.bin_start - dense[(r.column_name, r.bin)].bin_start) < 1e-9
        assert abs(r.bin_end - dense[(r.column_name, r.bin + r.bins - 1)].bin_end) < 1e-9
    assert seen == set(dense)


def test_histogram_runs_with_a_far_value(spark):
    from ticketlens.operators.stats import histogram, histogram_runs
    df = spark.createDataFrame([(i * 1e-6,) for i in range(1000)] + [(1e13,)], "x double")
    got = histogram_runs(df, ["x"]).collect()
    assert len(got) <= 1 + 2 * 1001 and sum(r["count"] for r in got) == 1001
    assert sum(r.bins for r in got) > 1 << 31 and max(r.bin_end for r in got) == pytest.approx(1e13)
    with pytest.raises(ValueError, match="histogram_runs"):
        histogram(df, "x")
    assert histogram_runs(df.where("false"), ["x"]).count() == 0
