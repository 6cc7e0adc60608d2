import re

import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm import quality
from tests.llm.frames import no_docs, odd_docs, prose

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark):
    import random
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(60), rng.choice([2, 6, 200])) + rng.choice(["", "\n", "\n\n*#", " é漢😀\x0b|"]) * rng.randrange(3)
             for _ in range(120)] + ["", None, "a b c d e a b c d e", "a a a a a a", "x\nx\n \nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.judge(df, keep_text=False).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(5)
    good, acc = 0.7, np.linspace(0.65, 0.95, len(quality.RULES))
    y = np.where(rng.random(30_000) < good, 1, -1)
    votes = np.where(rng.random((30_000, len(acc))) < acc, y[:, None], -y[:, None])
    votes[rng.random(votes.shape) < 0.4] = 0
    rows, n = np.unique(votes, axis=0, return_counts=True)
    m = quality.fit_votes([(tuple(r), int(c)) for r, c in zip(rows, n)], strength=0.001)
    assert abs(m["prior"] - good) < 0.02 and np.abs(np.array(m["accuracy"]) - acc).max() < 0.03
    empty = quality.fit_votes([])
    assert empty["prior"] == 0.8 and set(empty["accuracy"]) == {0.9}


def test_verdict_on_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    j = quality.judge(docs).drop("quality").join(labels, "doc_id").where(~F.col("base_failed"))
    n = {(r.quality, r.kept): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.05 * sum(v for k, v in n.items() if k[0] == 0)
    assert n.get((1, False), 0) <= 0.01 * sum(v for k, v in n.items() if k[0] == 1)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    with_text = quality.judge(docs)
    assert set(docs.columns) <= set(with_text.columns)
    a = sorted((str(r.doc_id), r.n_words, round(r.quality, 9)) for r in with_text.collect())
    b = sorted((str(r.doc_id), r.n_words, round(r.quality, 9)) for r in quality.judge(docs, keep_text=False).collect())
    assert a == b and len(a) == docs.count()
    assert quality.judge(no_docs(spark)).collect() == []
    assert quality.judge(no_docs(spark), keep_text=False).collect() == []
