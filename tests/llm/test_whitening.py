import random

import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm import whitening as W


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows):
    """n, S, integer vectors, eigenvalues and vectors by numpy in one place."""
    kept = [(i, [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    x = np.array(fit, dtype=object)
    n, s = len(fit), [sum(col) for col in x.T]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x.tolist()], dtype=float)
    e, v = np.linalg.eigh(c.T @ c / n)
    return kept, n, s, e[::-1], v[:, ::-1], float(np.trace(c.T @ c / n))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) * np.linspace(0.05, 3, 20)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(base)] + [(1000 + i, [float(x) for x in base[3]]) for i in range(200)]
    out, model = W.whiten(frame(spark, rows).repartition(7))
    got = {}
    for r in W.component_rows(out).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    kept, n, s, e, v, trace = brute(rows)
    assert model.n == n == 300 and model.sums == s and set(got) == {i for i, _ in kept}
    sign = np.sign((model.components * v[:, :16]).sum(axis=0))
    for i, x in kept:
        d = [n * a - b for a, b in zip(x, s)]
        proj = (np.array(d, dtype=float) / n) @ v[:, :16] / np.sqrt(e[:16]) * sign
        assert sorted(got[i]) == list(range(1, 17))
        for k, r in got[i].items():
            assert r.n == n and r.deviation == sum(t * t for t in d) == int(r.deviation_text)
            assert abs(r.whitened - proj[k - 1]) < 1e-8 and abs(r.explained - e[k - 1] / trace) < 1e-10
            assert r.identity_error < 1e-10


def test_ill_conditioned_and_dependent_columns(spark):
    """A constant, a copied and a nearly copied dimension beside a scale of a million."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 4))
    big = a[:, 0] * 2.0 ** 20
    near = big + rng.integers(0, 2, size=400) * 2.0
    m = np.stack([big, near, a[:, 1], a[:, 1], np.full(400, 7.0), a[:, 2], a[:, 3]], axis=1)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, model = W.whiten(df)
    assert model.components.shape[1] == 5 and model.identity_error < 1e-6
    x = np.floor(64 * m) + 1_000_000
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(model.eigenvalues, s[:5] ** 2 / 400, rtol=1e-6)
    y = np.array([r.whitened for r in out.select("whitened").collect()])
    assert np.abs(np.cov(y.T, bias=True) - np.eye(5)).max() < 1e-6


def test_qr_factor_and_parts(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, size=(200, 5))
    fit = spark.createDataFrame([([int(v) for v in r],) for r in x], "x array<long>")
    sums = W.vector_sums(fit, 5)
    assert sums == x.sum(axis=0).tolist()
    mean = W._mean(sums, 200)
    r, trace, passes = W.cholesky_qr(fit, mean, 200)
    c = x - x.mean(axis=0)
    assert passes >= 3 and np.allclose(r.T @ r, c.T @ c, rtol=1e-12) and np.allclose(r, np.triu(r)) and abs(trace - (c * c).sum()) < 1e-8
    q = W.solve_right(c, r)
    assert np.abs(q.T @ q - np.eye(5)).max() < 1e-13
    huge = spark.createDataFrame([([2 ** 60, -2 ** 60],)] * 9, "x array<long>")
    assert W.vector_sums(huge, 2) == [9 * 2 ** 60, -9 * 2 ** 60]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [random.Random(i).random(), random.Random(-i - 1).random()]) for i in range(12)]
    odd = [(100, None), (101, [None, 1.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [-inf, 0.0]), (105, [1.0]), (106, []),
           (107, [3e38, 1.0]), (None, [0.5, 0.5]), (None, [0.5, 0.5])]
    df = frame(spark, good + odd)
    for c in ("x", "n", "_row", "whitened", "deviation", "component", "i"):
        df = df.withColumn(c, F.lit("x"))
    out, model = W.whiten(df)
    rows = out.collect()
    assert len(rows) == 14 and model.n == 13 and out.columns[-6:] == W.ADDED
    assert all(len(r.whitened) == 2 and r.deviation is not None for r in rows)
    assert W.component_rows(out).count() == 28
    empty, none = W.whiten(df.where("false"))
    assert W.component_rows(empty).collect() == [] and none.n == 0
    same, one = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert one.n == 1 and [(r.deviation, r.whitened) for r in same.collect()] == [(0, []), (0, [])]
    wide, _ = W.whiten(spark.createDataFrame([(1, [2.0 ** 54]), (2, [-2.0 ** 54]), (3, [0.0])], "vec_id long, embedding array<double>"))
    got = {r.vec_id: r for r in wide.collect()}
    assert got[1].deviation is None and int(got[1].deviation_text) == (3 * 2 ** 60) ** 2
