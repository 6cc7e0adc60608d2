import random

from ticketlens.llm import decontaminate as dc
from tests.llm.frames import no_docs, odd_docs, prose


def brute_tile(text, item, k):
    """Greedy string tiling by comparing every pair of positions: (marked item words, tiles)."""
    mi, mt, tiles = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for i in range(len(text)):
                n = 0
                while p + n < len(item) and i + n < len(text) and item[p + n] == text[i + n] and not mi[p + n] and not mt[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, i)
        n, p, i = best
        if n < k:
            return sum(mi), tiles
        mi[p:p + n], mt[i:i + n], tiles = [True] * n, [True] * n, tiles + 1


def test_tiling_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        item = prose(rng, rng.randrange(5, 25), 30)
        w = item.split()
        cut = rng.randrange(len(w) + 1)
        pieces = [w[cut:], w[:cut], prose(rng, rng.randrange(20), 30).split(), w[3:9]]
        rng.shuffle(pieces)
        text = [x for p in pieces for x in p]
        block = dc.Block([(1, item.encode())], 3)
        got = block.matches(" ".join(text).encode(), 0.0)
        want = brute_tile(text, w, 3)
        assert (got[0][2] if got else 0) == want[0]


def test_reordered_and_partial_passages(spark):
    rng = random.Random(9)
    item = prose(rng, 40, 10_000)
    w = item.split()
    noise = lambda n: prose(random.Random(n), 200, 10_000)
    texts = [noise(1) + " " + item + " " + noise(2), noise(3) + " " + " ".join(w[20:]) + ". " + noise(4) + "\n" + " ".join(w[:20]).upper(),
             noise(5), noise(6) + " ".join(w[:10]), "", None, item + " " + item, " ".join(x for v in w for x in (v, "zz"))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "a b c"), (9, None), (10, ""), (11, noise(99))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.contamination(docs, bench).collect()}
    assert set(got) == {(0, 7), (1, 7), (6, 7)}
    assert got[0, 7].coverage == 1.0 and got[1, 7].tiles == 2 and got[6, 7].tiles == 1
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, bench).collect()) == [2, 3, 4, 5, 7]
    assert len(list(dc.blocks(bench, "text", "item_id", 5, block_words=30))) > 1
    assert {(r.doc_id, r.item_id) for r in dc.contamination(docs, bench, block_words=30).collect()} == set(got)
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, bench, block_words=30).collect()) == [2, 3, 4, 5, 7]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "text without an id and more"), (None, "another text under the same id"), (2, "another text under the same id")],
                                  "item_id long, text string")
    got = sorted((r.doc_id, str(r.item_id)) for r in dc.contamination(docs, bench).collect())
    assert got == [(3, "2"), (3, "None")]
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert dc.contamination(no_docs(spark), bench).collect() == []
    assert dc.contamination(docs, bench.where("false")).collect() == []
    assert dc.drop_contaminated(docs, bench.where("false")).count() == docs.count()
