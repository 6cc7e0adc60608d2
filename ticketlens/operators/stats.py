"""Distribution statistics: histogram (A17), Gaussian KDE (A18), pairwise
correlation (A19).

The histogram is a ``groupBy(bin)``; the KDE is evaluated from the occupied
cells of a grid finer than its bandwidth (linear work in rows, then cells x
points); the correlation matrix folds each task's rows into k x k moments.
NaN counts as missing in all three, as in pandas.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.operators.order_stats import exact_quantiles
from ticketlens.schema import quoted
from ticketlens.session import materialize

KDE_GRID = 200
KDE_CELLS = 64           # cells to a bandwidth


def _moments(df: DataFrame, col: str):
    x = F.col(quoted(col)).cast("double")
    ok = x.isNotNull() & ~F.isnan(x)
    return df.agg(F.count(F.when(ok, x)).alias("n"), F.min(F.when(ok, x)).alias("lo"),
                  F.max(F.when(ok, x)).alias("hi"), F.stddev_samp(F.when(ok, x)).alias("sd")).first()


def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> tuple[float, float, int]:
    """numpy ``bins='auto'``: the smaller of the Freedman-Diaconis and Sturges widths.

    Returns (first_edge, last_edge, n_bins).
    """
    first, last = lo, hi
    if first == last:
        first, last = first - 0.5, last + 0.5
    sturges = (hi - lo) / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd else sturges
    n_bins = int(math.ceil((last - first) / width)) if width else 1
    return first, last, max(n_bins, 1)


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """(bin, bin_start, bin_end, count) over non-null values, empty bins kept.

    The last bin is closed on the right, as in numpy.
    """
    m = _moments(df, col)
    spark = df.sparkSession
    if not m["n"]:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    if bins is None:
        q1, q3 = exact_quantiles(df, [col], [0.25, 0.75])[col]
        first, last, bins = auto_bins(m["n"], m["lo"], m["hi"], q1, q3)
    else:
        first, last = (m["lo"], m["hi"]) if m["lo"] != m["hi"] else (m["lo"] - 0.5, m["hi"] + 0.5)
    _bins_fit(bins)
    x = F.col(quoted(col)).cast("double")
    idx = F.least(F.lit(bins - 1), F.floor((x - F.lit(first)) * F.lit(bins / (last - first)))).cast("int")
    counts = (df.where(x.isNotNull() & ~F.isnan(x)).groupBy(idx.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    width = (last - first) / bins
    # every bin id, so that empty bins appear with count 0
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(first) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    (F.lit(first) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


DENSE_BINS = 1 << 31         # ids of a table that lists every bin are INT


def _bins_fit(bins: int) -> None:
    if bins >= DENSE_BINS:
        raise ValueError(f"{bins} bins are too many to list one by one; histogram_runs gives empty bins as runs")


def _specs(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float, int]]:
    """(first edge, last edge, bins) of every column with values, by the automatic rule."""
    stats = _column_stats(df, cols)
    live = [c for c in cols if stats[c][0]]
    q = exact_quantiles(df, live, [0.25, 0.75])
    return {c: auto_bins(*stats[c][:3], *q[c]) for c in live}


RUNS = "column_name string, bin long, bins long, bin_start double, bin_end double, count long"


def histogram_runs(df: DataFrame, cols: list[str]) -> DataFrame:
    """A17 for any spread: (column_name, bin, bins, bin_start, bin_end, count), empty bins as runs.

    An occupied bin is a row with ``bins`` = 1; a run of empty bins between two
    occupied ones is one row with ``count`` 0, its first bin and its length, so a value
    far from all others costs one row more.  The first and the last bin are always
    occupied.  Occupied bins are sorted by range; each range looks for its next bin in
    its own rows, and its last row takes the first bin of the next range that has rows
    (one row per range).  Values must be finite, as for numpy.
    """
    spark = df.sparkSession
    specs = _specs(df, cols)
    if not specs:
        return spark.createDataFrame([], RUNS)
    pairs = []
    for c, (first, last, bins) in specs.items():
        x = F.col(quoted(c)).cast("double")
        at = F.least(F.lit(bins - 1).cast("long"), F.floor((x - F.lit(first)) * F.lit(bins / (last - first))).cast("long"))
        pairs.append(F.when(x.isNotNull() & ~F.isnan(x), F.struct(F.lit(c).alias("column_name"), at.alias("bin"))))
    counts = (df.select(F.explode(F.filter(F.array(*pairs), lambda s: s.isNotNull())).alias("p"))
              .groupBy("p.column_name", "p.bin").agg(F.count(F.lit(1)).alias("count")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(n, "column_name", "bin").withColumn("_range", F.spark_partition_id()), "bins")
    key = F.struct("column_name", "bin")
    heads = ranged.groupBy("_range").agg(F.min(key).alias("head"))                       # one row per range
    heads = heads.select("_range", F.lead("head").over(Window.orderBy("_range")).alias("_next"))
    after = F.lead(key).over(Window.partitionBy("_range").orderBy("column_name", "bin"))
    t = ranged.withColumn("_after", after).join(F.broadcast(heads), "_range")
    t = t.withColumn("_after", F.coalesce("_after", "_next"))
    gap = F.when(F.col("_after.column_name") == F.col("column_name"), F.col("_after.bin") - F.col("bin") - 1)
    t = t.select("column_name", F.explode(F.filter(F.array(
        F.struct("bin", F.lit(1).cast("long").alias("bins"), "count"),
        F.when(gap > 0, F.struct((F.col("bin") + 1).alias("bin"), gap.alias("bins"), F.lit(0).cast("long").alias("count")))),
        lambda s: s.isNotNull())).alias("s"))
    edges = spark.createDataFrame([(c, f, (last - f) / bins) for c, (f, last, bins) in specs.items()], "column_name string, _f double, _w double")
    return t.join(F.broadcast(edges), "column_name").select(                            # one row per column
        "column_name", "s.bin", "s.bins", (F.col("_f") + F.col("s.bin") * F.col("_w")).alias("bin_start"),
        (F.col("_f") + (F.col("s.bin") + F.col("s.bins")) * F.col("_w")).alias("bin_end"), "s.count")


def histograms(df: DataFrame, cols: list[str]) -> DataFrame:
    """A21 (numeric part): (column_name, bin, bin_start, bin_end, count) for several
    columns, each with its own automatic bins, counted in one aggregate.

    Bin rules need count / min / max (one aggregate for all columns) and the
    quartiles (shared refinement passes); the counting pass unpivots
    (column, bin) pairs and groups them, so the result has at most
    sum(n_bins) rows whatever the row count.
    """
    spark = df.sparkSession
    xs = {c: F.col(quoted(c)).cast("double") for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        ok = xs[c].isNotNull() & ~F.isnan(xs[c])
        aggs += [F.count(F.when(ok, xs[c])).alias(f"n{i}"), F.min(F.when(ok, xs[c])).alias(f"lo{i}"),
                 F.max(F.when(ok, xs[c])).alias(f"hi{i}")]
    m = df.agg(*aggs).first()
    live = [(i, c) for i, c in enumerate(cols) if m[f"n{i}"]]
    q = exact_quantiles(df, [c for _, c in live], [0.25, 0.75])
    specs = {c: auto_bins(m[f"n{i}"], m[f"lo{i}"], m[f"hi{i}"], *q[c]) for i, c in live}
    if not specs:
        return spark.createDataFrame([], "column_name string, bin int, bin_start double, bin_end double, count long")
    pairs = []
    for c, (first, last, bins) in specs.items():
        _bins_fit(bins)
        idx = F.least(F.lit(bins - 1), F.floor((xs[c] - F.lit(first)) * F.lit(bins / (last - first)))).cast("int")
        pairs.append(F.when(xs[c].isNotNull() & ~F.isnan(xs[c]),
                            F.struct(F.lit(c).alias("column_name"), idx.alias("bin"))))
    counts = (df.select(F.explode(F.filter(F.array(*pairs), lambda s: s.isNotNull())).alias("p"))
              .groupBy("p.column_name", "p.bin").agg(F.count(F.lit(1)).alias("count")))
    # every bin of every column, so that empty bins show 0: one range over the summed
    # bins, each column from its offset, as a heavy tail can ask for millions of bins
    at, offsets, i = 0, [], F.lit(-1)
    for c, (first, last, bins) in specs.items():
        offsets.append(F.struct(F.lit(c).alias("column_name"), F.lit(first).alias("first"), F.lit(last).alias("last"),
                                F.lit(bins).cast("long").alias("bins"), F.lit(at).cast("long").alias("at")))
        i = i + (F.col("id") >= F.lit(at)).cast("int")
        at += bins
    width = (F.col("s.last") - F.col("s.first")) / F.col("s.bins")
    grid = spark.range(at).withColumn("s", F.array(*offsets)[i]).withColumn("b", F.col("id") - F.col("s.at"))
    grid = grid.select("s.column_name", F.col("b").cast("int").alias("bin"), (F.col("s.first") + F.col("b") * width).alias("bin_start"),
                       (F.col("s.first") + (F.col("b") + 1) * width).alias("bin_end"))
    return (grid.join(counts, ["column_name", "bin"], "left")
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long")))


def _column_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """(count, min, max, sample standard deviation) per column, NaN left out, in one aggregate."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(quoted(c)).cast("double")
        v = F.when(~F.isnan(x), x)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    m = df.agg(*aggs).first()
    return {c: (m[f"n{i}"], m[f"lo{i}"], m[f"hi{i}"], m[f"sd{i}"]) for i, c in enumerate(cols)}


KDE_SCHEMA = "column_name string, point int, x double, density double, curve double"


def kdes(df: DataFrame, cols: list[str], grid_size: int = KDE_GRID, cut: float = 0.0, cells: int = KDE_CELLS,
         curve: bool = True) -> DataFrame:
    """(column_name, point, x, density, curve) of Gaussian KDEs with Scott's bandwidth, as drawn over histograms.

    Bandwidth = sample std * n^(-1/5); ``grid_size`` points from min - cut*bw to
    max + cut*bw (the drawn curve has cut 0).  ``curve`` is the density on the
    count axis: density * n * width of the automatic histogram bins, whose exact
    quartiles take a few passes; ``curve=False`` saves them and leaves it null.

    Rows are gathered into cells of bandwidth / ``cells``; a cell acts through its
    count, mean and variance (second-order expansion of the kernel), and only
    occupied cells exist, so one far value costs one cell.  A constant or empty
    column has no curve.
    """
    spark = df.sparkSession
    stats = _column_stats(df, cols)
    live = [c for c in cols if stats[c][0] and stats[c][3]]
    if not live:
        return spark.createDataFrame([], KDE_SCHEMA)
    quart = exact_quantiles(df, live, [0.25, 0.75]) if curve else {}
    specs = []
    for c in live:
        n, lo, hi, sd = stats[c]
        bw = sd * n ** (-0.2)
        scale = None
        if curve:
            first, last, bins = auto_bins(n, lo, hi, *quart[c])
            scale = n * (last - first) / bins
        g0 = lo - cut * bw
        specs.append((c, bw, g0, (hi + cut * bw - g0) / (grid_size - 1), lo, 1.0 / (n * bw * math.sqrt(2 * math.pi)), scale))
    pairs = []
    for c, bw, _g0, _step, lo, _norm, _scale in specs:
        x = F.col(quoted(c)).cast("double")
        pairs.append(F.when(x.isNotNull() & ~F.isnan(x), F.struct(
            F.lit(c).alias("column_name"), F.floor((x - F.lit(lo)) / F.lit(bw / cells)).alias("cell"), x.alias("v"))))
    occupied = (df.select(F.explode(F.filter(F.array(*pairs), lambda s: s.isNotNull())).alias("s")).select("s.*")
                .groupBy("column_name", "cell")
                .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")))
    spec = spark.createDataFrame(specs, "column_name string, bw double, g0 double, step double, lo double, norm double, scale double")
    near = occupied.join(F.broadcast(spec), "column_name")               # one row per column
    u = lambda p: (F.col("g0") + p * F.col("step") - F.col("mean")) / F.col("bw")
    weight = lambda p: F.col("n") * F.exp(-0.5 * u(p) * u(p)) * (
        1.0 + 0.5 * (u(p) * u(p) - 1.0) * F.col("var") / (F.col("bw") * F.col("bw")))
    parts = near.select("column_name", "g0", "step", "norm", "scale", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(grid_size - 1)), weight)).alias("point", "w"))
    return (parts.groupBy("column_name", "point", "g0", "step", "norm", "scale").agg(F.sum("w").alias("w"))
            .select("column_name", F.col("point").cast("int").alias("point"), (F.col("g0") + F.col("point") * F.col("step")).alias("x"),
                    (F.col("w") * F.col("norm")).alias("density"), (F.col("w") * F.col("norm") * F.col("scale")).alias("curve")))


def kde(df: DataFrame, col: str, grid_size: int = KDE_GRID, cut: float = 0.0, cells: int = KDE_CELLS, curve: bool = True) -> DataFrame:
    """(point, x, density, curve) of one column; see ``kdes``."""
    return kdes(df, [col], grid_size, cut, cells, curve).drop("column_name")


def kde_exact(df: DataFrame, col: str, grid_size: int = KDE_GRID, cut: float = 0.0) -> DataFrame:
    """The same KDE summed over every row (one wide aggregate, no binning)."""
    m = _moments(df, col)
    spark = df.sparkSession
    n, lo, hi = m["n"], m["lo"], m["hi"]
    bw = m["sd"] * n ** (-0.2)
    g0, g1 = lo - cut * bw, hi + cut * bw
    step = (g1 - g0) / (grid_size - 1)
    x = F.col(quoted(col)).cast("double")
    row = df.where(x.isNotNull() & ~F.isnan(x)).agg(*[
        F.sum(F.exp(-0.5 * F.pow((F.lit(g0 + i * step) - x) / F.lit(bw), 2))).alias(f"g{i}")
        for i in range(grid_size)]).first()
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    return spark.createDataFrame([(i, g0 + i * step, row[f"g{i}"] * norm) for i in range(grid_size)],
                                 "point int, x double, density double")


def _moment_blocks(names: list[str], means: list[float]):
    """Per-partition masked moment sums for every column pair (numpy BLAS).

    For columns a, b and w = (a present) * (b present), with values centred
    on the global means: n = sum w, sa = sum w*a, saa = sum w*a^2,
    sab = sum w*a*b (and the mirrored sb, sbb).  Emits one row per pair i <= j.
    """
    import numpy as np
    import pandas as pd

    k = len(names)
    mu = np.array([0.0 if m is None else m for m in means])
    iu, ju = np.triu_indices(k)

    def run(batches):
        n = s1 = s2 = sab = None
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float, na_value=np.nan)
            m = (~np.isnan(x)).astype(float)
            c = np.where(m > 0, x - mu, 0.0)
            if n is None:
                n, s1, s2, sab = m.T @ m, c.T @ m, (c * c).T @ m, c.T @ c
            else:
                n += m.T @ m
                s1 += c.T @ m
                s2 += (c * c).T @ m
                sab += c.T @ c
        if n is None:
            return
        # s1[a, b] = sum over rows with both present of centred a
        yield pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"), "n": n[iu, ju],
                            "sa": s1[iu, ju], "sb": s1[ju, iu], "saa": s2[iu, ju], "sbb": s2[ju, iu],
                            "sab": sab[iu, ju]})
    return run


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature_x, feature_y, correlation) for every ordered pair, diagonal included.

    Pearson over rows where both values are present (pandas ``corr``); a
    constant or all-missing side gives NULL.  One scan: each task folds its
    rows into k x k moment matrices with numpy, emits k(k+1)/2 rows, and a
    partial aggregate sums them per pair -- the shuffle is k^2 rows per task,
    independent of the row count.  Values are centred on the global means
    (one aggregate) so the moment formula does not lose precision.
    """
    k = len(cols)
    names = [f"c{i}" for i in range(k)]
    values = [F.col(quoted(c)).cast("double") for c in cols]
    narrow = df.select(*[F.when(~F.isnan(v), v).alias(n) for v, n in zip(values, names)])
    row = narrow.agg(*[F.avg(n).alias(n) for n in names]).first()
    means = [row[n] for n in names]
    parts = narrow.mapInPandas(_moment_blocks(names, means),
                               "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ["n", "sa", "sb", "saa", "sbb", "sab"]])
    n = F.col("n")
    cov = F.col("sab") / n - (F.col("sa") / n) * (F.col("sb") / n)
    va = F.col("saa") / n - F.pow(F.col("sa") / n, 2)
    vb = F.col("sbb") / n - F.pow(F.col("sb") / n, 2)
    # a constant side has zero variance up to rounding: treat |var| below a
    # relative epsilon of the column's scale as zero (-> NULL correlation)
    eps_a = F.lit(1e-12) * (F.col("saa") / n + 1e-300)
    eps_b = F.lit(1e-12) * (F.col("sbb") / n + 1e-300)
    corr = F.when((n > 0) & (va > eps_a) & (vb > eps_b), cov / F.sqrt(va * vb))
    arr = F.array(*[F.lit(c) for c in cols])
    out = sums.select(F.element_at(arr, F.col("i") + 1).alias("feature_x"),
                      F.element_at(arr, F.col("j") + 1).alias("feature_y"), corr.alias("correlation"))
    mirrored = out.where(F.col("feature_x") != F.col("feature_y")).select(
        F.col("feature_y").alias("feature_x"), F.col("feature_x").alias("feature_y"), "correlation")
    return out.unionByName(mirrored)
