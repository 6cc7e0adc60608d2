"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles.
For radius r every bit position i gets a vector m(i) of r + 1 bits; the mask of
table v (1 <= v < 2**(r+1)) keeps the bits with <m(i), v> odd.  Two fingerprints
that differ in at most r positions span at most r vectors, so some v is
orthogonal to all of them: in that table the pair agrees under the mask and
meets in one bucket.  No pair within the radius can be missed.

Copies are one fingerprint with their smallest id.  A bucket yields a spanning
forest of its links (checked by Hamming distance), never all pairs; a bucket of
more than ``BUCKET`` fingerprints is dealt out again under the masks of another
independent family, for which the same guarantee holds, until all are small.
Components come from star contractions over the written links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import Scratch

BITS = 64
BUCKET = 4096            # fingerprints compared in one task at once; larger buckets are dealt out again
_CHUNK = 1 << 16


def fingerprint(raw: bytes, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text in UTF-8; 0 for a text without words."""
    words = raw.lower().split()               # bytes: lowers A-Z only, splits at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at:at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Column of signed 64-bit fingerprints over whole texts; a null text counts as empty."""
    @F.arrow_udf(T.LongType())
    def udf(raw: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), shingle) for x in raw], pa.int64())
    return udf(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(radius: int, family: int) -> list[int]:
    """Signed 64-bit masks of one family; any two fingerprints within ``radius`` agree under one of them."""
    size = 1 << (radius + 1)
    vectors = np.resize(np.arange(1, size), BITS)
    np.random.default_rng(family).shuffle(vectors)
    masks = []
    for v in range(1, size):
        bits = sum(1 << i for i in range(BITS) if bin(int(vectors[i]) & v).count("1") % 2)
        masks.append(bits - (1 << BITS) if bits >> (BITS - 1) else bits)
    return masks


def spanning_links(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``x`` (distinct int64) within ``radius`` bits."""
    links, left = [], x.view(np.uint64)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            near = np.bitwise_count(left ^ p) <= radius
            if near.any():
                new = left[near]
                links += [(int(p.view(np.int64)), int(q)) for q in new.view(np.int64)]
                front.extend(new)
                left = left[~near]
    return links


def _link_buckets(radius: int, bucket: int):
    """mapInArrow over rows sorted by (bucket, fp): links (kind 0) and members of buckets that are too large (kind 1)."""
    def run(batches):
        key, held, big = None, [], False
        out: list = []

        def close():
            if not big and len(held) > 1:
                out.extend((0, a, b) for a, b in spanning_links(np.array(held, np.int64), radius))

        def table():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                                               pa.array(cols[2], pa.int64())], ["kind", "a", "b"])

        for batch in batches:
            keys, fps = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            several = (ends - starts > 1)
            several[[0, -1]] = True                     # a run may go on in the next batch
            for s, e in zip(starts[several], ends[several]):
                if keys[s] != key:
                    close()
                    key, held, big = keys[s], [], False
                if big:
                    out.extend((1, int(key), int(f)) for f in fps[s:e])
                else:
                    held.extend(int(f) for f in fps[s:e])
                    if len(held) > bucket:
                        out.extend((1, int(key), f) for f in held)
                        held, big = [], True
                if len(out) > 100_000:
                    yield table()
        close()
        if out:
            yield table()
    return run


def links(fps: DataFrame, scratch: Scratch, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fp`` within ``radius`` bits, enough of them to connect every pair."""
    todo, found, family = fps.select(F.lit(0).cast("long").alias("path"), "fp"), [], 0
    while True:
        masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m"))
                          for i, m in enumerate(covering_masks(radius, family))])
        dealt = todo.select("path", "fp", F.explode(masks).alias("x")).select(
            F.xxhash64("path", "x.t", F.col("fp").bitwiseAND(F.col("x.m"))).alias("bucket"), "fp")
        dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
        got = scratch.write(dealt.mapInArrow(_link_buckets(radius, bucket), "kind int, a long, b long"), f"links{family}")
        found.append(got.where("kind = 0").select("a", "b"))
        over = got.where("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("fp"))
        if over.isEmpty():
            break
        todo, family = over, family + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node reachable, for nodes with an edge other than the root itself.

    Alternating large-star and small-star contractions; minima are aggregated
    map-side, and each round is written.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy(F.col("v").alias("c")).agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, both["v"] == low["c"]).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = scratch.write(large.where("v > u").distinct(), "large")
        low = large.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m"))
        hang = large.join(low, large["v"] == low["c"]).select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = hang.unionByName(low.select(F.col("c").alias("v"), F.col("m").alias("u"))).where("v > u").distinct()
        small = scratch.write(small, "small")
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(now, large)
        now = small
        if state == last:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", shingle: int = 3,
                    radius: int = 3, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp, component_id, component) per row, plus the columns of ``more``.

    component_id is the smallest id reachable over links, ``component`` the
    smallest fingerprint of the group.

    Defined cases: null and empty texts have fingerprint 0, linked like any
    other; null ids are never the smallest unless a group has no other; repeated
    rows share a fingerprint and group; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(docs.select(docs[id_col].alias("doc_id"), fingerprints(docs[text], shingle).alias("fp"),
                                     *[c.alias(k) for k, c in (more or {}).items()]), "rows")
    fps = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = stars(links(fps, scratch, radius), scratch)
    groups = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("component"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = scratch.write(groups.select("fp", "component").join(least, "component"), "groups")
    return rows.join(groups, "fp")


def keep_one(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Rows that tie for it are told apart by a hash of the text; of rows equal in
    both one stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    rows = near_duplicates(docs, text=text, id_col=id_col, more={"h": F.xxhash64(docs[text])}, **how)
    best = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id", "h").agg(
        F.count(F.lit(1)).alias("n"))
    best = scratch.write(best.groupBy("component").agg(F.min(F.struct("h", "doc_id", "n")).alias("x"))
                         .select(F.col("x.doc_id").alias("_id"), F.col("x.h").alias("_h"), F.col("x.n").alias("_n")), "best")
    same = F.xxhash64(docs[text])
    kept = docs.join(best, docs[id_col].eqNullSafe(best["_id"]) & (same == best["_h"]), "left_semi")
    again = best.where("_n > 1")
    if again.isEmpty():
        return kept
    on = lambda b: docs[id_col].eqNullSafe(b["_id"]) & (same == b["_h"])
    single = docs.join(best.where("_n = 1"), on(best), "left_semi")
    return single.unionByName(docs.join(again, on(again), "left_semi").dropDuplicates([id_col, text]))
