"""Line de-duplication by a suffix array over line-ID sequences, in DataFrame functions only.

All documents, ordered by id, form one sequence of line ids with a gap between
documents.  Ranks are built by prefix doubling: at depth 2**k a suffix's rank is
the left bound of its interval in the suffix array, so equal ranks mean equal
prefixes of 2**k lines, and (rank, size, depth) is a longest-common-prefix
interval.  A round pairs rank(g) with rank(g + 2**k); only suffixes whose prefix
occurs twice go on.  The rank inside an old interval is its left bound plus the
count of suffixes with a smaller second rank, a prefix sum over distinct pairs.

A run counts as repeated when it holds ``min_words`` words or more; in each
interval of such runs every suffix but the first in document order is a later
copy and its lines are deleted.  It is enough to look at windows that reach
``min_words`` with their last line or lose it without their first one: every line
of a longer repeated run lies in such a window of that run, and the window is
itself repeated.  A window has ``min_words`` lines at most (lines without a word
are no part of the sequence), which bounds the doubling; its interval at any
depth l is named by the ranks at 2**k of its two ends, 2**k <= l < 2**(k+1).
Overlapping windows merge into the maximal runs.

Each table is deleted as soon as its successor is written.  Every round shuffles rows of two or three integers of repeated lines only; a
line found in a third of all rows is counted before it is shuffled, and later
copies are found by an anti-join on positions, which no line can skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch, WORD, pack, prefix_sums, unpack

ADDED = ["n_lines", "n_deleted", "n_runs", "longest_run"]
BUCKETS = 1 << 20           # text hash buckets of changed documents: at most so many integers are broadcast


def sequences(docs: DataFrame, text: Column, id_col: Column) -> DataFrame:
    """(id, h, lines): h hashes the text, lines holds (a, b, words) per line; null texts have none."""
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"),
                              F.regexp_count(x, F.lit(WORD)).alias("words"))
    return docs.select(id_col.alias("id"), F.xxhash64(text).alias("h"),
                       F.transform(F.split(text, "\n", -1), line).alias("lines")).where("lines is not null")


def first_ranks(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """(g, r): r is the interval of each line that occurs twice or more, in line-id order."""
    ids = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    ranks = prefix_sums(scratch, scratch.write(ids, "ids"), ["a", "b"], F.col("size"), "r")
    return lines.select("g", "a", "b").join(ranks.select("a", "b", "r"), ["a", "b"]).select("g", "r")


def double(scratch: Scratch, active: DataFrame, depth: int) -> DataFrame:
    """Ranks at depth 2 * ``depth`` from those at ``depth``; suffixes that became unique leave.

    Sizes are summed over all pairs in (r, r2) order, and each interval's own start
    is taken off, so one with very many continuations needs no task of its own.
    """
    ahead = active.select((F.col("g") - depth).alias("g"), F.col("r").alias("r2"))
    pairs = active.join(ahead, "g")
    groups = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # written before the range split, whose sampling would compute the pairs again
    placed = prefix_sums(scratch, scratch.write(groups, "groups"), ["r", "r2"], F.col("size"), "before")
    start = placed.groupBy("r").agg(F.min("before").alias("start"))
    groups = placed.join(start, "r").withColumn("lb", F.col("r") + F.col("before") - F.col("start"))
    return pairs.join(groups.select("r", "r2", "lb"), ["r", "r2"]).select("g", F.col("lb").alias("r"))


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(g, l): minimal windows of ``min_words`` words, from their first line and up to their last line."""
    w = Window.partitionBy("base").orderBy("pos")
    t = lines.withColumn("cw", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    prev = F.col("cw") - F.col("words")
    ahead = F.coalesce(*[F.when(F.lead("cw", i).over(w) - prev >= min_words, F.lit(i + 1)) for i in range(min_words)])
    back = F.coalesce(*[F.when((F.col("o") >= i) & (F.col("cw") - F.lag(prev, i).over(w) >= min_words), F.lit(i + 1))
                        for i in range(min_words)])
    t = t.select("g", ahead.alias("f"), back.alias("b"))
    both = t.select(F.explode(F.array(F.struct(F.col("g"), F.col("f").alias("l")),
                                      F.struct((F.col("g") - F.col("b") + 1).alias("g"), F.col("b").alias("l")))).alias("x"))
    return both.select("x.g", "x.l").where("l is not null").distinct()


def dedup_lines(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", min_words: int = 10) -> DataFrame:
    """``docs`` with later copies cut out of ``text``, plus n_lines, n_deleted, n_runs and longest_run.

    Defined cases: documents are ordered by id (nulls last), then by a hash of
    the text; rows equal in id and text count as one document and are treated
    alike; a null text stays null and has no lines; an empty text is one line
    without a word; lines without a word are never deleted; an input column named
    like an added one gives way; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    seq = sequences(docs, docs[text], docs[id_col]).groupBy("id", "h").agg(F.first("lines").alias("lines"))
    filled = F.size(F.filter("lines", lambda x: x["words"] > 0))
    seq = prefix_sums(scratch, scratch.write(seq, "sequences"), [F.col("id").asc_nulls_last(), "h"], filled + 1, "base")
    every = seq.select("id", "h", "base", F.posexplode("lines").alias("pos", "x")).select(
        "id", "h", "base", "pos", "x.a", "x.b", "x.words")
    nth = Window.partitionBy("base").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("o", F.sum((F.col("words") > 0).cast("long")).over(nth) - 1)
    every = scratch.write(every.withColumn("g", F.when(F.col("words") > 0, F.col("base") + F.col("o"))), "lines")
    scratch.keep_only(every)
    lines = every.where("g is not null")

    mins = scratch.write(windows(lines, min_words), "windows")
    active, found = scratch.write(first_ranks(scratch, lines), "rank0"), []
    depth = 1
    while depth <= min_words:
        if depth > 1:
            active = scratch.write(double(scratch, active, depth // 2), f"rank{depth}")
        scratch.keep_only(every, mins, active, *found)
        here = mins.where((F.col("l") >= depth) & (F.col("l") < 2 * depth)).join(active.withColumnRenamed("r", "r1"), "g")
        if depth == 1:
            here = here.withColumn("r2", F.lit(0).cast("long"))
        else:
            end = here.withColumn("e", F.col("g") + F.col("l") - depth)
            here = end.join(active.select(F.col("g").alias("e"), F.col("r").alias("r2")), "e").select("g", "l", "r1", "r2")
        found.append(scratch.write(here, f"intervals{depth}"))
        depth *= 2
    scratch.keep_only(every, *found)
    found = reduce(DataFrame.unionByName, found)
    firsts = found.groupBy("l", "r1", "r2").agg(F.min("g").alias("g")).select("g", "l")
    later = found.join(firsts, ["g", "l"], "left_anti")
    gone = later.select(F.explode(F.sequence("g", F.col("g") + F.col("l") - 1)).alias("g")).distinct().withColumn("gone", F.lit(True))

    flags = every.select("id", "h", "base", "pos", "g").join(gone, "g", "left").groupBy("base").agg(
        F.first("id").alias("id"), F.first("h").alias("h"),
        F.count("gone").alias("n_deleted"),
        F.array_sort(F.collect_list(F.struct("pos", F.col("g").isNotNull().alias("filled"),
                                             F.coalesce("gone", F.lit(False)).alias("gone")))).alias("marks"))
    flags = flags.where("n_deleted > 0").select(
        F.col("id").alias("_id"), F.col("h").alias("_h"), "n_deleted", F.transform("marks", lambda x: x["gone"]).alias("gone"),
        F.aggregate(F.filter("marks", lambda x: x["filled"]),
                    F.struct(F.lit(0).alias("runs"), F.lit(0).alias("at"), F.lit(0).alias("longest")),
                    lambda a, x: F.struct(
                        (a["runs"] + F.when(x["gone"] & (a["at"] == 0), 1).otherwise(0)).alias("runs"),
                        F.when(x["gone"], a["at"] + 1).otherwise(0).alias("at"),
                        F.greatest(a["longest"], F.when(x["gone"], a["at"] + 1).otherwise(0)).alias("longest"))).alias("r"))
    flags = scratch.write(flags, "flags")
    scratch.keep_only(flags)

    # texts of documents that lose no line stay where they are: only those whose hash shares a bucket with a changed one are joined
    bucket = lambda h: F.pmod(F.col(h), F.lit(BUCKETS)).cast("int")
    changed = F.broadcast(flags.select(bucket("_h").alias("_b")).distinct())
    rows = pack(docs, id=docs[id_col], h=F.xxhash64(docs[text])).withColumn("_at", bucket("h"))
    near = rows.join(changed, F.col("_at") == F.col("_b"), "left_semi")
    far = rows.join(changed, F.col("_at") == F.col("_b"), "left_anti")
    near = near.join(flags, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    rows = near.unionByName(far.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in flags.schema]))
    old = F.col("_row").getField(text)
    kept = F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~F.col("gone")[i]), "\n")
    rows = rows.select(
        "_row", F.when(F.col("gone").isNull(), old).otherwise(kept).alias("_text"),
        F.when(old.isNull(), F.lit(0)).otherwise(F.length(old) - F.length(F.translate(old, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_deleted", F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(F.col("r.runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(F.col("r.longest"), F.lit(0)).cast("long").alias("longest_run"))
    return unpack(rows.withColumn("_row", F.col("_row").withField(text, F.col("_text"))), docs.columns, ADDED)
