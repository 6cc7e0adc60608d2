import numpy as np
import pytest

from pyspark.sql import functions as F

from ticketlens.operators import order_stats
from ticketlens.operators.order_stats import exact_quantiles, kth_smallest, modes


@pytest.mark.parametrize("final_rows", [4, 4096])
def test_kth_matches_sort(spark, final_rows):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(3, 2, 3000), np.full(1500, 42.0)])   # a third on one value
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double").repartition(5)
    s = np.sort(vals)
    ranks = [0, 1, 1499, 2000, 2250, 4499]
    got = kth_smallest(df, {"x": ranks}, final_rows=final_rows)
    for r in ranks:
        assert got[("x", r)] == s[r]


def test_quantiles_linear(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=999)
    b = rng.integers(0, 5, size=999).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    q = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], final_rows=8)
    for col, arr in (("a", a), ("b", b)):
        assert np.allclose(q[col], np.percentile(arr, [25, 50, 75]), rtol=0, atol=1e-12)
    # constant and all-missing columns
    c = spark.createDataFrame([(1.0, None)] * 4, "k double, z double")
    q2 = exact_quantiles(c, ["k", "z"], [0.25, 0.75])
    assert q2["k"] == [1.0, 1.0] and q2["z"] == [None, None]


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "v string")
    assert modes(df, ["v"]) == {"v": "a"}


def _fetches(monkeypatch):
    """Rows that each fetch brought to the driver."""
    seen, fetch = [], order_stats._fetch_windows

    def spy(df, probes, final_rows):
        got = fetch(df, probes, final_rows)
        seen.append(sum(map(len, got.values())))
        assert all(len(v) <= final_rows for v in got.values())
        return got
    monkeypatch.setattr(order_stats, "_fetch_windows", spy)
    return seen


def test_one_infinity_and_wide_spread_stay_bounded(spark, monkeypatch):
    seen = _fetches(monkeypatch)
    n = 200_000
    df = spark.range(n).select(
        F.when(F.col("id") == 7, float("inf")).otherwise(F.col("id") * 0.5).alias("a"),
        F.pow(F.lit(10.0), F.col("id") / (n / 600.0) - 300).alias("b"))
    q = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75])
    a = np.sort(np.where(np.arange(n) == 7, np.inf, np.arange(n) * 0.5))
    assert q["a"] == [float(np.quantile(a[:-1], 0) + v) for v in np.interp([0.25, 0.5, 0.75], np.arange(n) / (n - 1), a)]
    want = [10.0 ** ((n - 1) * p / (n / 600.0) - 300) for p in (0.25, 0.5, 0.75)]
    assert np.allclose(q["b"], want, rtol=1e-2)
    assert max(seen) <= 4 * 2 * order_stats.FINAL_ROWS
    ends = kth_smallest(df, {"a": [0, n - 1]})
    assert ends[("a", 0)] == 0.0 and ends[("a", n - 1)] == float("inf")


def test_longs_beyond_2_53(spark, monkeypatch):
    _fetches(monkeypatch)
    base = 2 ** 60
    df = spark.range(50_000).select((F.lit(base) + F.col("id")).alias("k"), F.lit(2 ** 62 + 1).alias("c")).repartition(4)
    got = kth_smallest(df, {"k": [0, 1, 12_345, 49_999], "c": [25_000]}, final_rows=50)
    assert [got[("k", r)] for r in (0, 1, 12_345, 49_999)] == [base, base + 1, base + 12_345, base + 49_999]
    assert got[("c", 25_000)] == 2 ** 62 + 1


def test_middle_splits_every_window():
    for lo, hi in [(-5, 9), (0.0, 1e-300), (-1e300, 1e300), (1.0, float("inf")), (float("-inf"), -1.0), (-1.0, 1.0)]:
        assert lo <= order_stats._middle(lo, hi) <= hi
