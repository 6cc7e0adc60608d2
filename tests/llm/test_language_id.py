import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import language_id as L
from tests.llm.frames import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def plain_symbols(text):
    s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return " " + " ".join(s.split()) + " " if s.split() else " "


def plain_vector(text, n=3, dim=L.DIM):
    """Bind and bundle letter by letter."""
    s, out = plain_symbols(text), np.zeros(dim)
    for i in range(len(s) - n + 1):
        g = s[i:i + n]
        if g.strip():
            v = np.ones(dim)
            for j, c in enumerate(g):
                v = v * np.roll(L.letter_vector(0 if c == " " else ord(c), dim), n - 1 - j)
            out += v
    return out


def test_bundles_against_plain_binding():
    rng = random.Random(1)
    texts = ["", "a", "Ab, cd!", " -- ", "éÉß 12 漢字漢字 x😀y İstanbul", "퟿𝒳𝒴 𐐀𐐁", "tab\tand\nline  two  spaces"]
    texts += ["".join(rng.choice("abcdefg ,.É") for _ in range(200)) for _ in range(20)]
    for n in (1, 2, 3, 4):
        got = L.bundle(texts, np.arange(len(texts)), len(texts), n, 64)
        assert np.array_equal(got, np.stack([plain_vector(t, n, 64) for t in texts]))
    both = L.bundle(texts, np.arange(len(texts)) % 2, 2, 3, 64)
    assert np.array_equal(both[0], sum(plain_vector(t, 3, 64) for t in texts[::2]))


def test_blocks_of_ngrams_add_up(monkeypatch):
    texts = ["the quick brown fox jumps", "over the lazy dog"]
    whole = L.bundle(texts, np.arange(2), 2)
    monkeypatch.setattr(L, "BLOCK", 5)
    assert np.array_equal(whole, L.bundle(texts, np.arange(2), 2))
    monkeypatch.setattr(L, "TILE_ROWS", 2)
    assert list(L.tiles(["a"] * 5)) == [(0, 2), (2, 4), (4, 5)] and list(L.tiles([])) == []


def test_predictions_against_brute_force(spark):
    rng = random.Random(2)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["größe", "straße", "über"], "cc": ["niño", "año", "que"]}
    docs = []
    for i in range(60):
        lang = rng.choice(list(words))
        docs.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 9))), lang if i % 7 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs}
    protos = {k: sum(plain_vector(t) for i, t, g in docs if g == k and not held[i]) for k in words}
    got = {r.doc_id: r for r in L.identify(df).collect()}
    for i, t, _ in docs:
        v = plain_vector(t)
        cos = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in protos.items()}
        best = max(sorted(cos), key=lambda k: cos[k])
        assert got[i].held_out == held[i] and got[i].lang_pred == best and abs(got[i].score - cos[best]) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.identify(docs)
    row = out.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] >= 0.99


def test_predictions_ignore_the_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = L.held_out(F.col("doc_id"))
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    pick = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in L.identify(d).collect())
    assert pick(docs) == pick(other)


def test_odd_rows(spark, monkeypatch):
    docs = odd_docs(spark).withColumn("lang", F.when(F.col("doc_id") >= 3, "w").otherwise("s"))
    for c in ("held", "score", "held_out", "lang_pred", "vec", "i"):
        docs = docs.withColumn(c, F.lit("x"))
    out = L.identify(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns[-3:] == L.ADDED
    for r in rows:
        empty = not r.text or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == empty and 0.0 <= r.score <= 1.0
    assert L.identify(no_docs(spark)).collect() == []
    unlabelled = L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    monkeypatch.setattr(L, "MAX_LANGUAGES", 1)
    many = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.identify(many)
