import re

from pyspark.sql import functions as F

from ticketlens.llm import license_scan as ls
from tests.llm.frames import no_docs, odd_docs

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_phrases_against_brute_force(spark):
    texts = ["Under the MIT license, under the mit\nLICENSE!", "under the mit licenseX", "cc by nc cc-by-nc CC BY NC", "Apache License, Version 2.0",
             "apache license version 20", "x" * 50, "É under the mit license ß", "under the the mit license", "nc cc by", "", "two words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.license_table(df).collect()}
    for i, t in enumerate(texts):
        w = W.findall(t.translate(LOWER))
        hits = [(s, p.label) for p in ls.PHRASES for q in [p.text.split()] for s in range(len(w)) if w[s:s + len(q)] == q]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == (min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_diagonals_merge_over_inserted_words(spark):
    words = ls.NOTICES[0].text.split()
    edited = words[:20] + ["really"] + words[20:30] + words[31:]
    far = words[:20] + ["filler"] * 40 + words[20:]
    rows = [(1, " ".join(edited)), (2, " ".join(words[:15])), (3, " ".join(far)), (4, " ".join(["x"] * 500 + words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every, spans = ls.scan(df, ls.NOTICES)
    got = {r.id: r for r in spans.where("label = 'mit'").collect()}
    assert set(got) == {1, 4} and got[4].first == 500 and got[4].coverage == 1.0 and 0.8 <= got[1].coverage < 1
    assert got[1]["last"] == len(W.findall(" ".join(edited))) - 1
    small, ls.BLOCK_POSITIONS = ls.BLOCK_POSITIONS, 30
    try:
        again = {(r.id, r.label, r.first, round(r.coverage, 9)) for r in ls.scan(df, ls.NOTICES)[1].collect()}
    finally:
        ls.BLOCK_POSITIONS = small
    assert again == {(r.id, r.label, r.first, round(r.coverage, 9)) for r in spans.collect()}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = ls.license_table(docs).collect()
    assert len(out) == docs.count() and all(r.n_base == 0 and r.labels == "" for r in out)
    assert ls.license_table(no_docs(spark)).collect() == []
    twice = spark.createDataFrame([(1, "under the MIT license")] * 3 + [(None, "under the MIT license")], "doc_id long, text string")
    assert [(r.n_base, r.labels) for r in ls.license_table(twice.withColumn("label", F.lit("z"))).collect()] == [(1, "mit")] * 4
