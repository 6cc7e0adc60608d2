import math
import random
import re
import zlib
from collections import Counter

from ticketlens.llm import lattice_lm as lm
from tests.llm.frames import no_docs, odd_docs, prose


def all_ways(pieces, text):
    """Sum over every segmentation, by enumeration."""
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        head = text[:n]
        if head in pieces.log:
            total += math.exp(pieces.log[head]) * all_ways(pieces, text[n:])
        elif n == 1:
            total += math.exp(sum(pieces.byte[b] for b in head.encode())) * all_ways(pieces, text[n:])
    return total


def small():
    return lm.Pieces({"▁": 1.0, "▁a": 2.0, "a": 1.5, "b": 1.0, "ab": 3.0, "ba": 0.5, "aba": 0.7, "▁ab": 0.2}, [0.01] * 256, 1.0)


def test_forward_recursion_sums_all_segmentations():
    p = small()
    assert math.isclose(sum(map(math.exp, p.log.values())) + sum(map(math.exp, p.byte)) + math.exp(p.end), 1.0)
    for w in ("a", "ab", "abab", "baaba", "cab", "ébc", "漢"):
        assert math.isclose(math.exp(p.marginal(w)), all_ways(p, "▁" + w), rel_tol=1e-9)
    assert math.isfinite(p.marginal("ab" * 20_000))


def test_expected_counts_spell_the_word():
    p = small()
    for w in ("abab", "cab", "aaé"):
        into = {}
        p.expected(w, 3.0, into)
        spelled = sum(n * (len(k.encode()) if isinstance(k, str) else 1) for k, n in into.items())
        assert math.isclose(spelled, 3.0 * len(("▁" + w).encode()), rel_tol=1e-9)
    before = p.marginal("abab")
    into = {}
    p.expected("abab", 5.0, into)
    assert p.refit(into, 1.0).marginal("abab") > before


def test_many_words_at_a_time_equal_one_by_one():
    import numpy as np
    p = small()
    words = ["a", "ab", "abab", "baaba", "cab", "ébc", "漢", "", "b" * 70, "ab" * 40, "aé漢b", "abab"]
    assert np.allclose(p.marginals(words), [p.marginal(w) for w in words], rtol=1e-12)
    n = np.arange(1, len(words) + 1)
    pieces, chars, want = np.zeros(len(p.names)), {}, {}
    p.expect(words, n, pieces, chars)
    for w, c in zip(words, n):
        p.expected(w, float(c), want)
    for name, v in zip(p.names, pieces):
        assert math.isclose(v, want.get(name, 0.0), rel_tol=1e-9, abs_tol=1e-12)
    got = Counter()
    for c, v in chars.items():
        for b in (lm._utf8(c) if c >= 0 else (-1 - c,)):
            got[b] += v
    assert {b: round(v, 6) for b, v in got.items()} == {b: round(v, 6) for b, v in want.items() if isinstance(b, int)}


def test_against_brute_force(spark):
    rng = random.Random(2)
    low = {i: i + 32 for i in range(65, 91)}
    texts = [prose(rng, rng.randrange(30), 80).upper() + rng.choice(["", " É\x0bß", " 漢 x\u00a0y"]) for _ in range(80)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(df).collect()}
    old, lm.HOT = lm.HOT, 30                    # most words take the join
    try:
        again = {r.doc_id: r for r in lm.score(df).collect()}
    finally:
        lm.HOT = old
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, v in toks.items() if not held[i] for w in v)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        for r in (got[i], again[i]):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
            assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(got[i].score, again[i].score, rel_tol=1e-9) and got[i].score < 0


def test_learned_model_beats_first_weights_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = lm.score(docs, rounds=0).where("held_out").agg({"score": "sum"}).first()[0]
    b = lm.score(docs, rounds=1).where("held_out").agg({"score": "sum"}).first()[0]
    assert b > 0.9 * a and b > a


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = lm.score(docs).collect()
    assert len(rows) == docs.count() and all(r.n_tokens == 1 for r in rows if not (r.n_known - 1) and r.n_tokens == 1)
    assert lm.score(no_docs(spark)).collect() == []
    from pyspark.sql import functions as F
    untrained = lm.score(docs, hold=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in untrained)
