import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ticketlens.llm import simhash as sh
from ticketlens.llm.common import Scratch
from tests.llm.frames import no_docs, odd_docs, prose


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=3):
    """{row number: smallest id reachable} for (id, fp) rows."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin((rows[i][1] ^ rows[j][1]) & (2 ** 64 - 1)).count("1") <= radius:
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def test_masks_cover_every_pair_within_the_radius():
    for family in range(4):
        masks = [m & (2 ** 64 - 1) for m in sh.covering_masks(3, family)]
        assert len(masks) == 15
        for bits in itertools.combinations(range(64), 3):
            diff = sum(1 << b for b in bits)
            assert any(not diff & m for m in masks)


def test_fingerprints_and_components(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(60)]
    texts += [texts[i] for i in range(10)] + [texts[i] + " tail" for i in range(10, 20)] + ["", None, "É É é 漢 a B", " \n", "one", "One two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(sh.near_duplicates(df).select("doc_id", "fp", sh.hex_of(F.col("fp")).alias("x"), "component_id").collect())
    assert [r.x for r in got] == [f"{brute_fp(t):016x}" for t in texts]
    assert [r.component_id for r in got] == brute_components([(r.doc_id, r.fp) for r in got])


def test_dense_clusters_are_dealt_out_again(spark):
    """Chains and balls of fingerprints, with buckets far smaller than the clusters."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(4):
        x = int(rng.integers(0, 2 ** 63))
        for _ in range(120):
            fps.add(x)
            for b in rng.integers(0, 64, size=rng.integers(1, 5)):
                x ^= 1 << int(b)
    fps |= {int(v) for v in rng.integers(0, 2 ** 63, size=100)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (4096, 6):
        scratch = Scratch(spark, "t")
        roots = {r.node: r.root for r in sh.stars(sh.links(df, scratch, 3, bucket), scratch).collect()}
        want = brute_components(list(zip(fps, fps)))
        assert [roots.get(f, f) for f in fps] == want


def test_odd_rows_and_keep_one(spark):
    docs = odd_docs(spark)
    rows = sh.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert len({r.component for r in rows}) == kept.count()
    assert sh.near_duplicates(no_docs(spark)).collect() == [] and sh.keep_one(no_docs(spark)).collect() == []
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x")], "doc_id long, text string")
    assert sh.keep_one(nulls).count() == 2
