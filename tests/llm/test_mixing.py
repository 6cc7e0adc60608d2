import math

from pyspark.sql import functions as F

from ticketlens.llm import mixing
from tests.llm.frames import no_docs, odd_docs


def mixed(docs):
    return mixing.mix(docs, mixing.word_count(docs["text"]), mixing.quality_weight(docs["text"]))


def water_fill(sizes, weights, share, cap):
    """Targets by repeated resharing, as a check of the closed form."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_targets_budgets_and_reruns(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), "abcde"[min(i % 9, 4)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixed(docs).collect()
    assert len(out) == 900
    by = {}
    for r in out:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken // r.size >= r.epochs                      # complete epochs come first
    names = sorted(by)
    want = water_fill([by[n][0] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for n, t in zip(names, want):
        assert by[n][3] == by[n][0] and math.isclose(by[n][2], t, rel_tol=1e-9)
        assert abs(by[n][1] - t) <= 1
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(out) == key(mixed(docs.repartition(7)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(out) == key(mixed(docs).collect())


def test_fraction_follows_the_keys(spark):
    rows = [(i, "a b c", "x" if i < 50 else "y") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(0.25)
    out = mixing.mix(docs, mixing.word_count(docs["text"]), weight, share=0.5, source_weights=(1, 1)).select(
        "doc_id", "source", "taken", mixing.exponential_key(F.col("doc_id"), weight, 7).alias("key")).collect()
    for s in "xy":
        mine = sorted((r for r in out if r.source == s), key=lambda r: r.key)
        cut = [r.taken for r in mine]
        assert cut == sorted(cut, reverse=True) and sum(0 < t < 3 for t in cut) <= 1
    heavy = sum(r.taken for r in out if r.doc_id % 2 == 0)
    assert heavy > 0.7 * sum(r.taken for r in out)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = mixed(docs)
    assert out.columns[-5:] == mixing.ADDED and "_row" in out.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r.size == 0 and r.taken == 0 for r in rows if not (r.text or "").strip())
    same = [r.taken for r in rows if r.text and r.text.startswith("One two")]
    assert len(same) == 2 and same[0] == same[1]
    assert mixed(no_docs(spark)).collect() == []
    few = mixing.mix(docs, mixing.word_count(docs["text"]), mixing.quality_weight(docs["text"]), columns=["doc_id", "lang"])
    assert few.columns == ["doc_id", "lang", *mixing.ADDED]
    pairs = lambda d: sorted((str(r.doc_id), r.size, r.taken) for r in d)
    assert pairs(few.collect()) == pairs(rows)
    weightless = mixing.mix(docs, mixing.word_count(docs["text"]), F.lit(0.0)).collect()
    assert len(weightless) == len(rows)


def test_hot_repeated_row_shares_the_cut(spark):
    rows = [(7, "a b c d", "s")] * 300 + [(i, "a b c d", "s") for i in range(100, 110)] + [(900, "x " * 4000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [r for r in mixed(docs).collect() if r.source == "s"]
    assert len({r.taken for r in out if r.doc_id == 7}) == 1
    assert abs(sum(r.taken for r in out) - out[0].target) <= 301
