"""Embedding whitening by shifted CholeskyQR over distributed rows.

The fit list holds each distinct integer vector once.  Its rows, centred, form a
tall matrix X that only ever exists as a written table of integer vectors.  One
pass sums the Gram matrix of X (numpy inside the tasks, d x d partial sums);
its Cholesky factor, taken with a small shift so that it exists for any X, gives
R1 and Q1 = X R1^-1.  Further passes solve each row against the factors so far
and factor the Gram matrix of what comes out, until Q is orthogonal; R is the
product of the factors.  X = QR, so the singular values and right vectors of the
small R are those of X: the components and their eigenvalues (sigma^2 / n) to
double precision, which the covariance itself, squaring the condition number,
would not give.

Only d x d matrices reach the driver or are broadcast, and d is checked against
``MAX_DIM``.  A lost executor costs the partial sums of its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch, pack, unpack

MAX_DIM = 4_096             # d x d doubles: 134 MB, the most that is sent to the driver or broadcast
LARGEST = 2.0 ** 61         # entries of an integer vector stay below, so differences of two fit 64 bits
ADDED = ["n", "deviation", "deviation_text", "whitened", "explained", "identity_error"]


@dataclass
class Whitening:
    n: int
    sums: list[int]                 # S, exact
    components: np.ndarray          # d x k, unit columns
    eigenvalues: np.ndarray         # k, falling
    explained: np.ndarray           # eigenvalue / trace
    identity_error: float | None
    passes: int                     # Gram passes that orthogonalised

    @property
    def dim(self) -> int:
        return len(self.sums)


def integer_vectors(vector, scale: float, offset: int):
    """floor(scale * c) + offset per entry as long; null where an entry is null, not finite or beyond 64 bits."""
    fits = lambda c: F.coalesce(F.abs(F.lit(float(scale)) * c.cast("double")) < F.lit(LARGEST), F.lit(False))
    whole = lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset).cast("long")              # noqa: E731
    return F.when(F.forall(vector, lambda c: fits(c) & ~F.isnan(c.cast("double"))), F.transform(vector, whole))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n in double: the whole part of the mean is taken off in 64-bit integers first."""
    return (x - whole).astype(np.float64) - rest


def _mean(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def solve_right(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q r^-1 for upper triangular r: one triangular solve for all rows."""
    q = q.copy(order="F")
    for j in range(r.shape[0]):
        if j:
            q[:, j] -= q[:, :j] @ r[:j, j]
        q[:, j] /= r[j, j]
    return q


def vector_sums(fit: DataFrame, dim: int) -> list[int]:
    """Exact sum of every dimension: high and low halves are summed apart, in decimals across tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), dim)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array((x >> 31).sum(axis=0)),
                                                  pa.array((x & 0x7FFFFFFF).sum(axis=0))], ["i", "hi", "lo"])
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = fit.select("x").mapInArrow(run, "i int, hi long, lo long").groupBy("i").agg(wide("hi").alias("hi"), wide("lo").alias("lo")).collect()
    sums = [0] * dim
    for r in rows:
        sums[r.i] = int(r.hi) * 2 ** 31 + int(r.lo)
    return sums


def gram(fit: DataFrame, mean: tuple[np.ndarray, np.ndarray], solves: list[np.ndarray], project: np.ndarray | None = None
         ) -> tuple[np.ndarray, np.ndarray]:
    """(Q'Q, column sums of Q) over all rows, Q being the centred rows solved against ``solves`` or projected."""
    dim, width = len(mean[0]), len(mean[0]) if project is None else project.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((mean, solves, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        (whole, rest), factors, weights = shared.value
        g, s = np.zeros((width, width)), np.zeros(width)
        for b in batches:
            q = _centred(_matrix(b.column(0), dim), whole, rest)
            for r in factors:
                q = solve_right(q, r)
            if weights is not None:
                q = q @ weights
            g += q.T @ q
            s += q.sum(axis=0)
        part = TaskContext.get().partitionId()
        rows = np.vstack([g, s])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(np.full(width + 1, part, dtype=np.int32)),
             pa.array(list(rows), type=pa.list_(pa.float64()))], ["i", "part", "row"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:      # one row per task and matrix row, in a fixed order
        total = np.sum(np.stack(rows.sort_values("part")["row"].to_list()), axis=0)
        return pd.DataFrame({"i": [rows["i"].iloc[0]], "row": [total]})

    parts = fit.select("x").mapInArrow(run, "i int, part int, row array<double>")
    out = np.zeros((width + 1, width))
    for r in parts.groupBy("i").applyInPandas(add, "i int, row array<double>").collect():
        out[r.i] = r.row
    shared.unpersist()
    return out[:width], out[width]


def cholesky_qr(fit: DataFrame, mean: tuple[np.ndarray, np.ndarray], n: int, tolerance: float = 1e-12, max_passes: int = 8
                ) -> tuple[np.ndarray, float, int]:
    """(R, trace of X'X, passes) of the centred rows X = QR.

    The first factor is shifted by 11 (n d + d (d + 1)) u |X|^2; later ones only
    where the plain factor does not exist (dependent columns).  Three passes at
    least; more until the columns that carry weight are orthogonal.
    """
    dim = len(mean[0])
    g, _ = gram(fit, mean, [])
    trace, solves, total, alive = float(np.trace(g)), [], np.eye(dim), None
    if trace == 0.0:
        return np.zeros((dim, dim)), 0.0, 1
    while True:
        shift = 11.0 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * float(np.linalg.norm(g, 2))
        try:
            if not solves:
                raise np.linalg.LinAlgError
            r = np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            r = np.linalg.cholesky(g + shift * np.eye(dim)).T
        solves.append(r)
        total = r @ total
        g, _ = gram(fit, mean, solves)
        now = np.diag(g) > 0.5
        off = np.abs(g[np.ix_(now, now)] - np.eye(int(now.sum()))).max(initial=0.0)
        if len(solves) >= 3 and ((off < tolerance and alive is not None and (alive == now).all()) or len(solves) >= max_passes):
            return total, trace, len(solves)
        alive = now


def fit_whitening(vectors: DataFrame, dim: int, components: int = 16, rank_tolerance: float = 1e-11) -> Whitening:
    """Components of the distinct rows of ``vectors`` (a column ``x`` array<long>, all of length ``dim``)."""
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; at most {MAX_DIM} are supported")
    scratch = Scratch(vectors.sparkSession, "whitening")
    fit = scratch.write(vectors.select("x").distinct(), "fit")
    n = fit.count()
    if n == 0 or dim == 0:
        return Whitening(n, [0] * dim, np.zeros((dim, 0)), np.zeros(0), np.zeros(0), None, 0)
    sums = vector_sums(fit, dim)
    mean = _mean(sums, n)
    r, trace, passes = cholesky_qr(fit, mean, n)
    _, sigma, vt = np.linalg.svd(r)
    k = int(min(components, (sigma > rank_tolerance * sigma[0]).sum())) if sigma[0] > 0 else 0
    w = vt[:k].T
    w = w * np.where(w[np.abs(w).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)       # largest entry positive
    e = sigma[:k] ** 2 / n
    error = None
    if k:
        g, s = gram(fit, mean, [], w / np.sqrt(e))
        error = float(np.abs(g / n - np.outer(s / n, s / n) - np.eye(k)).max())
    scratch.drop(fit)
    return Whitening(n, sums, w, e, e / (trace / n) if trace else e, error, passes)


def _exact_squares(d: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """sum over dimensions of (n * d - rest)^2 per row, as n^2 sum d^2 - 2 n sum d rest + sum rest^2."""
    most = int(np.abs(d).max(initial=0))
    if most * max(most, n) * max(d.shape[1], 1) >= 2 ** 62:
        d = d.astype(object)
    square, cross = (d * d).sum(axis=1), (d * np.array(rest, dtype=d.dtype)).sum(axis=1)
    own = sum(x * x for x in rest)
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(square.tolist(), cross.tolist())]


def whiten(df: DataFrame, *, vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, components: int = 16
           ) -> tuple[DataFrame, Whitening]:
    """``df`` with n, deviation, deviation_text, whitened (array), explained (array) and identity_error; and the model.

    Defined cases: rows whose vector is null or holds a null, NaN, infinite or
    (after scaling) beyond-64-bit entry go, and so do vectors whose length is not
    the table's most frequent one (ties: the longest), which have no place in one
    covariance; repeated rows stay but count once in the fit; ids play no part, so
    they may be null or repeated; components without variance (constant or
    dependent dimensions) are not returned, so the arrays may be shorter than
    ``components``, and empty when all vectors agree; ``deviation`` is null where
    the exact value passes 64 bits (``deviation_text`` has it always); an input
    column named like an added one gives way; an empty table gives an empty one.
    """
    rows = pack(df, x=integer_vectors(df[vector], scale, offset)).where("x is not null")
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    dim = top.d if top else 0
    rows = rows.where(F.size("x") == dim)
    model = fit_whitening(rows.select("x"), dim, components)
    n, k = model.n, model.components.shape[1]
    mean = _mean(model.sums, n) if n else (np.zeros(0, dtype=np.int64), np.zeros(0))
    rest = [s % n for s in model.sums] if n else []
    shared = df.sparkSession.sparkContext.broadcast((mean, rest, model.components / np.sqrt(model.eigenvalues) if k else None))

    @F.pandas_udf("struct<dev: string, w: array<double>>")
    def place(xs: pd.Series) -> pd.DataFrame:
        (whole, part), left, weights = shared.value
        x = np.stack(xs.to_list()).astype(np.int64) if dim and len(xs) else np.zeros((len(xs), dim), dtype=np.int64)
        w = _centred(x, whole, part) @ weights if weights is not None else np.zeros((len(xs), 0))
        return pd.DataFrame({"dev": [str(v) for v in _exact_squares(x - whole, n, left)], "w": list(w)})

    out = rows.withColumn("_p", place("x")).select(
        "_row", F.lit(n).cast("long").alias("n"), F.expr("try_cast(_p.dev as bigint)").alias("deviation"),
        F.col("_p.dev").alias("deviation_text"), F.col("_p.w").alias("whitened"),
        F.lit([float(v) for v in model.explained]).cast("array<double>").alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"))
    return unpack(out, df.columns, ADDED), model


def component_rows(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per input row and component, numbered from 1."""
    return (whitened.select(id_col, "n", "deviation", "deviation_text", "explained", "identity_error",
                            F.posexplode("whitened").alias("at", "value"))
            .select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                    F.col("explained")[F.col("at")].alias("explained"), "identity_error", "deviation_text"))
