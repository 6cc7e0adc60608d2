import numpy as np
from pyspark.sql import functions as F

from ticketlens.operators.numbering import running_totals


def test_running_totals_any_partitioning(spark):
    rng = np.random.default_rng(1)
    vals = rng.permutation(2000)
    df = spark.createDataFrame([(float(v), int(v % 7)) for v in vals], "k double, w long")
    want = np.cumsum([int(v % 7) for v in range(1999, -1, -1)])
    for parts in (1, 2, 200):
        out = running_totals(df.repartition(parts), "k", ["w"], descending=True, partitions=parts)
        got = [r.cum_w for r in out.orderBy(F.col("k").desc()).collect()]
        assert got == list(want)


def test_number_rows_with_a_hot_key(spark):
    from ticketlens.operators.numbering import number_rows
    # a third of the rows share one key, half of those differ in another column; the rest are unique
    rows = [("hot", None, i % 2 and i) for i in range(1500)] + [(f"k{i}", None if i % 2 else "x", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, oid string, v long").repartition(7)
    cond = F.col("oid").isNull()
    out, again = number_rows(df, cond, "key", "n"), number_rows(df.repartition(3), cond, "key", "n")
    m = df.where(cond).count()
    assert sorted(r.n for r in out.where(F.col("n").isNotNull()).collect()) == list(range(m))
    assert out.where(F.col("n").isNull()).count() == df.count() - m
    pairs = lambda d: sorted((r.key, r.v, r.n) for r in d.where("n is not null and not (key = 'hot' and v = 0)").collect())
    assert pairs(out) == pairs(again)                    # rows that differ have a fixed order
    import hashlib
    keys = sorted({r[0] for r in rows if r[1] is None}, key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))
    first = {r.key: r.n for r in out.where("n is not null").orderBy(F.desc("n")).collect()}
    assert [k for k, _ in sorted(first.items(), key=lambda kv: kv[1])] == keys
