"""Exact order statistics that never gather a column into one task.

``percentile``/``median`` in Spark keep a value->count map per group; for a
global aggregate that map is merged in a single task and grows with the
number of distinct values.  Here an exact k-th smallest value is found by
refining a window by count:

1. one aggregate gives count, min and max of every column;
2. each round asks a bounded sketch (``percentile_approx`` over the window) for
   values just below and above the wanted rank, and counts exactly how many
   values lie below, on, between and above these splitters; the range that
   holds the rank becomes the new window, some thousand times smaller whatever
   the spread of the values;
3. should a window not shrink by half, its middle value (among the numbers that
   the type can hold) joins the splitters, so 64 further rounds always suffice;
4. a window whose min equals its max, or a splitter that holds the rank, is the
   answer (a value with a third of all rows resolves in one round);
5. a window of at most ``final_rows`` values is fetched and the rank read off.

Whole numbers are compared as BIGINT, so ranks are exact beyond 2**53; all other
types as DOUBLE with NaN left out, infinities ordered as such.  Quantiles use
linear interpolation between the two neighbouring ranks (pandas / numpy
"linear", DuckDB ``quantile_cont``), over non-null values.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.schema import quoted

FINAL_ROWS = 4096
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 2.0 / SKETCH_ACCURACY


@dataclass
class _Target:
    col: str
    rank: int          # 0-based rank among the column's non-null values
    lo: float | int
    hi: float | int
    below: int         # values strictly before the window
    count: int         # values inside the window
    value: float | int | None = None
    slow: bool = False

    @property
    def done(self) -> bool:
        return self.value is not None


def _valid(df: DataFrame, col: str):
    if isinstance(df.schema[col].dataType, T.IntegralType):
        c = F.col(quoted(col)).cast("long")
        return c, c.isNotNull()
    c = F.col(quoted(col)).cast("double")
    return c, c.isNotNull() & ~F.isnan(c)


def column_ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """(non-null count, min, max) per column in one aggregate."""
    aggs = []
    for i, col in enumerate(cols):
        c, ok = _valid(df, col)
        v = F.when(ok, c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {col: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, col in enumerate(cols)}


def _middle(lo, hi):
    """A value between lo and hi that halves the numbers of the type between them."""
    if isinstance(lo, int):
        return (lo + hi) // 2

    def order(x: float) -> int:
        bits = struct.unpack("<q", struct.pack("<d", x))[0]
        return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)

    mid = (order(lo) + order(hi)) // 2
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(mid)))[0], -1.0 if mid < 0 else 1.0)


def kth_smallest(df: DataFrame, ranks: dict[str, list[int]], *, final_rows: int = FINAL_ROWS,
                 ranges: dict[str, tuple[int, float | None, float | None]] | None = None
                 ) -> dict[tuple[str, int], float | int | None]:
    """Exact k-th smallest non-null value for every (column, rank) asked."""
    cols = list(ranks)
    ranges = ranges or column_ranges(df, cols)
    targets: list[_Target] = []
    out: dict[tuple[str, int], float | int | None] = {}
    for col in cols:
        n, lo, hi = ranges[col]
        for r in sorted(set(ranks[col])):
            if n == 0 or r < 0 or r >= n:
                out[(col, r)] = None
                continue
            t = _Target(col, r, lo, hi, 0, n)
            if lo == hi:
                t.value = lo
            targets.append(t)

    while open_ := [t for t in targets if not t.done and t.count > final_rows]:
        probes = _probes(open_)
        splits = _splitters(df, probes)
        rows = _count_pass(df, probes, splits)
        for pid, (_key, members) in enumerate(probes):
            for t in members:
                cum, before = t.below, t.count
                for _b, cnt, bmin, bmax in sorted(rows.get(pid, [])):
                    if cum + cnt > t.rank:
                        t.lo, t.hi, t.below, t.count = bmin, bmax, cum, cnt
                        if bmin == bmax:
                            t.value = bmin
                        break
                    cum += cnt
                t.slow = t.count * 2 > before

    rest = [t for t in targets if not t.done]
    if rest:
        probes = _probes(rest)
        fetched = _fetch_windows(df, probes, final_rows)
        for pid, (_key, members) in enumerate(probes):
            vals = fetched.get(pid, [])
            for t in members:
                t.value = vals[t.rank - t.below]
    for t in targets:
        out[(t.col, t.rank)] = t.value
    return out


def _probes(targets: list[_Target]):
    """Targets that share a column and window are served by one probe."""
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault((t.col, t.lo, t.hi), []).append(t)
    return list(groups.items())


def _window_hits(df: DataFrame, probes):
    hits = []
    for pid, ((col, lo, hi), _members) in enumerate(probes):
        c, ok = _valid(df, col)
        hits.append((pid, c, ok & (c >= F.lit(lo)) & (c <= F.lit(hi))))
    return hits


def _splitters(df: DataFrame, probes) -> list[list]:
    """Per probe the ascending values at which its window is cut."""
    aggs = []
    for pid, c, inside in _window_hits(df, probes):
        fractions = sorted({min(max((t.rank - t.below + 0.5) / t.count + m, 0.0), 1.0)
                            for t in probes[pid][1] for m in (-SKETCH_MARGIN, SKETCH_MARGIN)})
        aggs.append(F.percentile_approx(F.when(inside, c), fractions, SKETCH_ACCURACY).alias(f"s{pid}"))
    row = df.agg(*aggs).first()
    out = []
    for pid, ((_col, lo, hi), members) in enumerate(probes):
        cuts = {v for v in row[f"s{pid}"] or [] if lo <= v <= hi}
        if not cuts or any(t.slow for t in members):
            cuts.add(_middle(lo, hi))
        out.append(sorted(cuts))
    return out


def _count_pass(df: DataFrame, probes, splits) -> dict[int, list[tuple]]:
    """(range, count, min, max) per probe: ranges below, on and between its splitters."""
    by_type: dict[str, list] = {}
    for pid, c, inside in _window_hits(df, probes):
        b = F.lit(0)
        for s in splits[pid]:
            b = b + (c >= F.lit(s)).cast("int") + (c > F.lit(s)).cast("int")
        kind = "long" if isinstance(df.schema[probes[pid][0][0]].dataType, T.IntegralType) else "double"
        nothing = F.lit(None).cast("double" if kind == "long" else "long")
        by_type.setdefault(kind, []).append(F.when(inside, F.struct(
            F.lit(pid).alias("p"), b.alias("b"), (c if kind == "long" else nothing).alias("i"),
            (c if kind == "double" else nothing).alias("x"))))
    hits = F.filter(F.array(*[h for hs in by_type.values() for h in hs]), lambda s: s.isNotNull())
    agg = (df.select(F.explode(hits).alias("s")).select("s.*").groupBy("p", "b")
           .agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i0"), F.max("i").alias("i1"),
                F.min("x").alias("x0"), F.max("x").alias("x1")))
    rows: dict[int, list[tuple]] = {}
    for r in agg.collect():                   # probes x (2 * splitters + 1) rows
        lo, hi = (r["i0"], r["i1"]) if r["i0"] is not None else (r["x0"], r["x1"])
        rows.setdefault(r["p"], []).append((r["b"], r["n"], lo, hi))
    return rows


def _fetch_windows(df: DataFrame, probes, final_rows: int) -> dict[int, list]:
    structs = []
    for pid, c, inside in _window_hits(df, probes):
        whole = isinstance(df.schema[probes[pid][0][0]].dataType, T.IntegralType)
        structs.append(F.when(inside, F.struct(
            F.lit(pid).alias("p"), (c if whole else F.lit(None).cast("long")).alias("i"),
            (F.lit(None).cast("double") if whole else c).alias("x"))))
    small = (df.select(F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("s"))
             .select("s.*"))
    most = final_rows * len(probes)
    got = small.limit(most + 1).collect()
    if len(got) > most:
        raise RuntimeError(f"more than {most} values in windows counted as at most that many: the input changed meanwhile")
    vals: dict[int, list] = {}
    for r in got:
        vals.setdefault(r["p"], []).append(r["x"] if r["i"] is None else r["i"])
    for v in vals.values():
        v.sort()
    return vals


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], **kw
                    ) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column (NULL/NaN ignored)."""
    if not cols:
        return {}
    ranges = column_ranges(df, cols)
    want: dict[str, list[int]] = {}
    plan: dict[str, list[tuple[int, int, float]]] = {}
    for col in cols:
        n = ranges[col][0]
        plan[col] = []
        want[col] = []
        for p in probs:
            if n == 0:
                plan[col].append((-1, -1, 0.0))
                continue
            h = p * (n - 1)
            r0 = int(math.floor(h))
            r1 = min(r0 + 1, n - 1)
            plan[col].append((r0, r1, h - r0))
            want[col] += [r0, r1]
    vals = kth_smallest(df, want, ranges=ranges, **kw)
    out: dict[str, list[float | None]] = {}
    for col in cols:
        res = []
        for r0, r1, frac in plan[col]:
            if r0 < 0:
                res.append(None)
                continue
            v0, v1 = float(vals[(col, r0)]), float(vals[(col, r1)])
            res.append(v0 if frac == 0 or v0 == v1 else v0 + (v1 - v0) * frac)
        out[col] = res
    return out


def exact_medians(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    q = exact_quantiles(df, cols, [0.5], **kw)
    return {c: v[0] for c, v in q.items()}


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, count) for several columns in one shuffle.

    The columns are unpivoted to (column, value) rows and counted with a
    partial (map-side) aggregate, so a value holding a third of all rows
    collapses to one row per map task before the shuffle.  NULL values are
    dropped, as in ``value_counts``.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column_name", "kv.value")
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column; ties go to the smallest value."""
    if not cols:
        return {}
    vc = value_counts(df, cols)
    best = vc.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))).alias("mode"))
    found = {r["column_name"]: r["mode"] for r in best.collect()}
    return {c: found.get(c) for c in cols}
