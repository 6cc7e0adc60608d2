"""Mixing sources to target weights (Efraimidis-Spirakis sampling).

Every document draws an exponential key ``-ln(u) / weight``; ``u`` comes from
the md5 of its id and a seed, so reruns agree.  A source whose target exceeds
its size is first taken in whole epochs; what remains of its budget goes to its
documents in ascending key order, prefix-summed up to the budget.  The document
on the cut gives only the words that are left, so a source meets its target.

The cut is found without sorting a source: words are summed by source and key
cell (4,096 cells, then 4,096 within the cell on the cut), and only the rows of
that last cell are ordered.  All other rows compare their key with the cut in
the scan, so no text is shuffled and a hot source is spread over every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch, WORD, pack, unpack

CELLS = 4096
BROADCAST_SOURCES = 100_000      # plans of so many sources are broadcast (one short row each)
ADDED = ["size", "source_size", "target", "epochs", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """1 for plain prose down to 0.1 for texts in which a tenth of the characters are markup symbols."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 9.0 * symbols / F.nullif(n, F.lit(0))), F.lit(1.0))


def exponential_key(id_: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1]; a null weight counts as 1, one that is not positive sorts last."""
    digits = F.substring(F.md5(F.concat_ws("#", F.coalesce(id_.cast("string"), F.lit("")), F.lit(str(seed)))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1.0) / float(2 ** 52)
    w = F.coalesce(weight.cast("double"), F.lit(1.0))
    return F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf")))


def targets(totals: DataFrame, source_weights: tuple, share: float, cap: float) -> DataFrame:
    """Per source (`source`, `source_size`): target, epochs and the words left for the fractional part.

    Targets share ``share`` of all words by weight and stop at ``cap`` times the
    source; the excess is reshared by weight.  That is the water level lambda
    with sum(min(cap, lambda * weight)) = total, found by taking sources in the
    order in which they reach their cap.  One row per source throughout.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    weights = F.array(*[F.lit(float(w)) for w in source_weights])
    t = totals.withColumn("w", weights[(F.row_number().over(by_name) - 1) % len(source_weights)])
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
         .withColumn("k", F.row_number().over(fill)))
    fits = F.col("cap") >= F.col("level") * F.col("w")
    t = t.withColumn("lam", F.min_by(F.col("level"), F.when(fits, F.col("k"))).over(every))
    t = t.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("lam") * F.col("w")), F.col("cap")))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                     .otherwise(F.lit(0)).cast("long"))
    return t.select("source", "source_size", "target", "epochs",
                    F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long").alias("budget"))


def _cut_cell(rows: DataFrame, plan: DataFrame, cell: Column) -> DataFrame:
    """Per source the cell in which the running sum passes the budget, and what is left of it there."""
    sums = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("n"))
    j = sums.alias("a").join(plan.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source")))
    j = j.select("a.source", "cell", "n", "budget")
    run = F.sum("n").over(Window.partitionBy("source").orderBy("cell"))
    return (j.withColumn("cum", run)
            .where((F.col("cum") > F.col("budget")) & (F.col("cum") - F.col("n") <= F.col("budget")))
            .select("source", "cell", (F.col("budget") - (F.col("cum") - F.col("n"))).alias("budget")))


def mix(docs: DataFrame, size: Column, weight: Column, *, source: str = "source", id_col: str = "doc_id",
        source_weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7,
        columns: list[str] | None = None) -> DataFrame:
    """``docs`` plus size, source_size, target, epochs and taken (words the mix takes, repeats counted).

    With ``columns`` only these input columns come back: they are written beside
    the keys, and the texts are read once.  Otherwise sizes and keys are computed
    again in a second scan, which costs less than writing the texts.

    Defined cases: a null source is a source of its own (ordered last); an
    empty or null text has size 0 and takes 0; a source without words has
    target 0; a null id hashes like an empty one and orders first; rows that tie
    in key, id and size share the words on the cut evenly (rounded down), so
    repeated rows are treated alike; an input column named like an added one
    gives way to it; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = pack(docs, source=docs[source], id=docs[id_col], size=size,
                key=exponential_key(docs[id_col], weight, seed))
    if columns is None:
        columns, rows = docs.columns, scratch.write(base.select("source", "id", "size", "key"), "rows")
    else:
        keep = F.struct(*[F.col("_row").getField(c).alias(c) for c in columns])
        base = scratch.write(base.withColumn("_row", keep), "rows")
        rows = base.select("source", "id", "size", "key")
    plan = scratch.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                                 source_weights, share, cap), "plan")

    p = 1.0 - F.exp(-F.col("key"))                       # position of the key among all exponential keys
    c1 = F.least(F.floor(p * CELLS), F.lit(CELLS - 1))
    c2 = F.least(F.floor((p * CELLS - c1) * CELLS), F.lit(CELLS - 1))
    cut1 = _cut_cell(rows, plan.select("source", "budget"), c1)
    in1 = (rows.withColumn("c1", c1).alias("r")
           .join(cut1.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("c1") == F.col("c.cell")))
           .select("r.source", "id", "size", "key", "budget"))
    in1 = scratch.write(in1, "cell")
    cut2 = _cut_cell(in1, in1.groupBy("source").agg(F.first("budget").alias("budget")), c2)
    in2 = (in1.drop("budget").withColumn("c2", c2).alias("r")
           .join(cut2.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("c2") == F.col("c.cell")))
           .select("r.source", "id", "size", "key", "budget"))
    ties = in2.groupBy("source", "budget", "key", "id", "size").agg(F.count(F.lit(1)).alias("m"))
    run = F.sum(F.col("size") * F.col("m")).over(Window.partitionBy("source").orderBy("key", "id", "size"))
    cut = scratch.write(
        ties.withColumn("cum", run).withColumn("prev", F.col("cum") - F.col("size") * F.col("m"))
        .where((F.col("cum") > F.col("budget")) & (F.col("prev") <= F.col("budget")))
        .select("source", F.struct("key", "id", "size").alias("at"),
                F.floor((F.col("budget") - F.col("prev")) / F.col("m")).cast("long").alias("part")), "cut")
    scratch.drop(in1)

    plan = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
        F.col("p.source").alias("_source"), "source_size", "target", "epochs", "at", "part")
    if plan.count() <= BROADCAST_SOURCES:          # beyond that, a join by source that Spark can split
        plan = F.broadcast(plan)
    me = F.struct("key", "id", "size")
    extra = (F.when(me < F.col("at"), F.col("size")).when(me.eqNullSafe(F.col("at")), F.col("part"))
             .otherwise(F.lit(0).cast("long")))
    out = (base.join(plan, F.col("source").eqNullSafe(F.col("_source")))
           .withColumn("taken", F.col("epochs") * F.col("size") + extra))
    return unpack(out, columns, ADDED)
