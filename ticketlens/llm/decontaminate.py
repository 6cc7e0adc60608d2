"""Benchmark decontamination by greedy string tiling.

Texts become sequences of lower-cased letter-digit words.  Seeds are the
``min_match``-grams of the test items, found in a document by a rolling
Karp-Rabin hash.  Seeds of one item on one diagonal grow into maximal matches
(checked word by word); tiling then takes the longest match again and again and
marks its words on both sides, cutting what overlaps marked words, until no match
of ``min_match`` words is left.  The share of the item's words under tiles is its
coverage, however the passages are ordered in the document.

The items are the stated query set: they are matched in blocks of at most
``BLOCK_WORDS`` words.  One block at a time is read, broadcast and held against
every document inside one scan, so no text is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import Scratch

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_WORDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)          # odd: the rolling hash is taken modulo 2**64

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("item_words", T.LongType()),
                                  T.StructField("matched", T.LongType()), T.StructField("tiles", T.LongType())]))


def words_of(raw: bytes) -> list[bytes]:
    return WORDS.findall(raw.lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of every window of k word ids."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = h * _BASE + ids[j:j + n]
    return h


class Block:
    """Test items with their words as ids, and the places of every seed."""

    def __init__(self, items: list[tuple[int | None, bytes]], k: int):
        self.k, self.vocab, self.items = k, {}, []
        places: dict[int, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(raw)], np.uint64)
            for p, h in enumerate(rolling(ids, k)):
                places.setdefault(int(h), []).append((len(self.items), p))
            self.items.append((item_id, ids))
        self.places = places
        self.seeds = np.array(sorted(places), np.uint64)

    def matches(self, raw: bytes, threshold: float) -> list[tuple]:
        """(item_id, item words, matched words, tiles) of the items whose coverage reaches ``threshold``."""
        k, seeds = self.k, self.seeds
        if not len(seeds) or len(raw) < 2 * k - 1:
            return []
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words_of(raw)], np.uint64)
        if np.count_nonzero(ids) < k:
            return []
        h = rolling(ids, k)
        at = np.searchsorted(seeds, h)
        at[at == len(seeds)] = 0
        hits = np.flatnonzero(seeds[at] == h)
        if not len(hits):
            return []
        diagonals: dict[tuple[int, int], list[int]] = {}
        for i in hits.tolist():
            for item, p in self.places[int(h[i])]:
                diagonals.setdefault((item, i - p), []).append(p)
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for (item, d), ps in diagonals.items():
            own = self.items[item][1]
            for a, b in _stretches(ps, k):
                same = ids[a + d:b + d] == own[a:b]                  # the check of the rolling hash
                by_item.setdefault(item, []).extend((b2 - a2, a2 + a, a2 + a + d) for a2, b2 in _true_runs(same))
        out = []
        for item, runs in by_item.items():
            item_id, own = self.items[item]
            matched, tiles = tile(runs, len(own), k)
            if matched >= threshold * len(own):
                out.append((item_id, len(own), matched, tiles))
        return out


def _stretches(starts: list[int], k: int):
    """Half-open stretches covered by windows of k words at ascending ``starts``."""
    a = b = None
    for p in starts:
        if b is not None and p <= b:
            b = p + k
        else:
            if b is not None:
                yield a, b
            a, b = p, p + k
    yield a, b


def _true_runs(flags: np.ndarray):
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tile(runs: list[tuple[int, int, int]], length: int, k: int) -> tuple[int, int]:
    """Greedy string tiling of (length, item start, text start) runs: (marked item words, tiles)."""
    item, text, tiles = np.zeros(length, bool), set(), 0
    heap = [(-n, p, i) for n, p, i in runs if n >= k]
    heapq.heapify(heap)
    while heap:
        n, p, i = heapq.heappop(heap)
        n = -n
        free = ~item[p:p + n]
        if not free.any():
            continue
        free &= np.fromiter((x not in text for x in range(i, i + n)), bool, n)
        if free.all():
            item[p:p + n] = True
            text.update(range(i, i + n))
            tiles += 1
        else:
            for a, b in _true_runs(free):
                if b - a >= k:
                    heapq.heappush(heap, (a - b, p + a, i + a))
    return int(item.sum()), tiles


def blocks(benchmark: DataFrame, text: str, id_col: str, k: int, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of bounded size, one at a time; an item that is longer than a block is one of its own."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("id"), F.encode(F.coalesce(benchmark[text], F.lit("")), "UTF-8").alias("raw"))
    held, size = [], 0
    for r in rows.orderBy("id", "raw").toLocalIterator():
        n = len(words_of(bytes(r["raw"])))
        if held and size + n > block_words:
            yield Block(held, k)
            held, size = [], 0
        held.append((r["id"], bytes(r["raw"])))
        size += n
    if held:
        yield Block(held, k)


def matches(text: Column, shared: Broadcast, threshold: float) -> Column:
    """Array of the items of one broadcast block that a text holds; a null or empty text holds none."""
    @F.arrow_udf(MATCH)
    def udf(raw: pa.Array) -> pa.Array:
        b = shared.value
        names = ("item_id", "item_words", "matched", "tiles")
        return pa.array([[dict(zip(names, m)) for m in b.matches(x.as_py(), threshold)] for x in raw],
                        pa.list_(pa.struct([(n, pa.int64()) for n in names])))
    return udf(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", id_col: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id", min_match: int = 5,
                  threshold: float = 0.6, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, item_words, matched, tiles, coverage.

    Defined cases: null texts count as empty; items of fewer than ``min_match``
    words never match; repeated documents and repeated items each have rows of
    their own; null ids are passed on; other columns are ignored; with either
    table empty the result is empty.
    """
    sc, scratch, out = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "items"), None
    for block, last in _with_last(blocks(benchmark, item_text, item_id, min_match, block_words)):
        shared = sc.broadcast(block)
        rows = docs.select(docs[id_col].alias("doc_id"), F.explode(matches(docs[text], shared, threshold)).alias("m"))
        rows = rows.select("doc_id", "m.*", (F.col("m.matched") / F.col("m.item_words")).alias("coverage"))
        if not last:                       # written before the next block takes its place
            rows = scratch.write(rows, "matches")
            shared.unpersist()
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = docs.where(F.lit(False)).select(docs[id_col].alias("doc_id"), *[
            F.lit(None).cast("long").alias(c) for c in ("item_id", "item_words", "matched", "tiles")], F.lit(0.0).alias("coverage"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text",
                      item_id: str = "item_id", min_match: int = 5, threshold: float = 0.6,
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no test item; defined cases as in ``contamination``."""
    sc, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "clean")
    for block, last in _with_last(blocks(benchmark, item_text, item_id, min_match, block_words)):
        shared = sc.broadcast(block)
        kept = docs.where(F.size(matches(docs[text], shared, threshold)) == 0)
        if not last:
            kept = scratch.write(kept, "kept")
            scratch.drop(docs)
            shared.unpersist()
        docs = kept
    return docs


def _with_last(items):
    """(item, whether it is the last) of an iterator."""
    ahead = next(items, None)
    while ahead is not None:
        item, ahead = ahead, next(items, None)
        yield item, ahead is None
