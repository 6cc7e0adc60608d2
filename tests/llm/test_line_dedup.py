import random
import re

from pyspark.sql import functions as F

from ticketlens.llm import line_dedup
from ticketlens.llm.common import Scratch
from tests.llm.frames import no_docs, odd_docs


def brute(docs, min_words):
    """Every position's longest earlier match; its lines go when they hold ``min_words`` words."""
    seq, where = [], {}
    for did, text in sorted(docs):
        for i, line in enumerate(text.split("\n")):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if n:
                where.setdefault(line, []).append(len(seq))
                seq.append((did, i, line, n))
        seq.append(None)
    gone = set()
    for g, x in enumerate(seq):
        best = 0
        for p in where[x[2]] if x else ():
            if p >= g:
                break
            n = 0
            while seq[g + n] and seq[p + n] and seq[g + n][2] == seq[p + n][2]:
                n += 1
            best = max(best, n)
        if best and sum(seq[g + i][3] for i in range(best)) >= min_words:
            gone |= {seq[g + i][:2] for i in range(best)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_against_brute_force(spark):
    rng = random.Random(1)
    for min_words in (10, 5, 7):
        docs = [(i, "\n".join(rng.choice(["a", "b c", "d e f", "g h i j k l m n o p q", "", "a"]) + rng.choice(["", "", " x"])
                              for _ in range(rng.randrange(26)))) for i in range(50)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=min_words).collect()}
        assert {k: r.text for k, r in got.items()} == brute(docs, min_words)
        for k, t in docs:
            assert got[k].n_lines == len(t.split("\n")) and len(got[k].text.split("\n")) >= got[k].n_lines - got[k].n_deleted
            assert got[k].longest_run <= got[k].n_deleted and (got[k].n_runs > 0) == (got[k].n_deleted > 0)


def test_ranks_are_suffix_array_intervals(spark):
    """Ranks at depth 1, 2 and 4 against a sorted list of the suffixes that occur twice."""
    seq = [random.Random(2).choice("abc") for _ in range(80)]
    lines = spark.createDataFrame([(g, s) for g, s in enumerate(seq)], "g long, s string").select(
        "g", F.ascii("s").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    scratch = Scratch(spark, "t")
    active = line_dedup.first_ranks(scratch, lines)
    for depth in (1, 2, 4):
        if depth > 1:
            active = line_dedup.double(scratch, active, depth // 2)
        prefix = {g: "".join(seq[g:g + depth]) for g in range(len(seq) - depth + 1)}
        twice = {g: p for g, p in prefix.items() if list(prefix.values()).count(p) > 1}
        got = {r.g: r.r for r in active.collect()}
        assert set(got) == set(twice)
        order = sorted(set(twice.values()))
        assert [got[next(g for g in twice if twice[g] == p)] for p in order] == sorted(set(got.values()))
        for g, p in twice.items():
            assert all((got[g] == got[x]) == (p == q) for x, q in twice.items())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = line_dedup.dedup_lines(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns[-4:] == line_dedup.ADDED
    assert [r.n_lines for r in rows if r.text is None] == [0, 0]
    same = {(r.text, r.n_deleted) for r in rows if r.text and r.text.startswith("One two")}
    assert len(same) == 1
    assert line_dedup.dedup_lines(no_docs(spark)).collect() == []
    hot = spark.createDataFrame([(i, "the very same line with more than ten words in it again\nown %d" % i) for i in range(300)],
                                "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(hot).collect()}
    assert got[0].startswith("the very") and all(got[i] == f"own {i}" for i in range(1, 300))
