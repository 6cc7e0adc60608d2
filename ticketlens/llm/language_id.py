"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 in ``DIM`` dimensions, drawn from
its code point, so all tasks draw the same.  An n-gram binds its letters: their
vectors, rotated by their distance from its end, are multiplied.  A document
bundles (adds) the vectors of its n-grams; a language prototype bundles those of
all its training documents.  A document gets the language whose prototype has
the greatest cosine with its own vector.

Bundling is linear, so equal n-grams of a stretch of documents are counted first
and bound once: the sums are counts times n-gram vectors, a matrix product over
blocks of n-grams whose size is bounded whatever the script.  All sums are whole
numbers and don't depend on how rows meet in tasks.  Prototypes are summed per
task, then per (language, dimension) over the cluster, so a language with a third
of all documents meets in no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ticketlens.llm.common import Scratch, pack, unpack

DIM = 1_024
SEED = 42
MAX_LANGUAGES = 20_000      # prototypes are broadcast: 80 MB at most; a column with more values names no languages
TILE_CHARS = 1 << 20        # documents are bundled together up to so many characters ...
TILE_ROWS = 256             # ... and so many rows
BLOCK = 8_192               # n-grams bound at a time
FLUSH = 1_000               # languages that a task sums before it hands on
UNDETERMINED = "und"
ADDED = ["held_out", "lang_pred", "score"]

_letters: dict[tuple[int, int], np.ndarray] = {}


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """The random vector of a code point (0: a gap between words)."""
    if (code, dim) not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[code, dim] = (np.random.default_rng([SEED, code]).integers(0, 2, dim) * 2 - 1).astype(np.int8)
    return _letters[code, dim]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text number) of all lower-cased letters; other runs, starts and ends are one gap (0) each."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    present, inverse = np.unique(codes, return_inverse=True) if len(codes) and codes.max() > 0xFFFF else _small_unique(codes)
    letter = np.array([chr(c).isalpha() for c in present.tolist()], dtype=bool)[inverse]
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]                                  # a gap stays where a letter stands before it
    first = np.ones(len(codes), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    keep |= first                                            # and at the start of every text
    # a first gap may be followed by more: only the start itself stays, so at most one gap in a row
    return codes[keep], owner[keep]


def _small_unique(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, dtype=np.int64)
    place[seen] = np.arange(len(seen))
    return seen, place[codes]


def ngrams(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of each distinct n-gram, its number per window, owner per window); windows of gaps alone don't count."""
    if len(codes) < n:
        return np.zeros((0, n), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    present, inverse = _small_unique(codes) if codes.max() <= 0xFFFF else np.unique(codes, return_inverse=True)
    k, m = len(present), len(codes) - n + 1
    inside = owner[:m] == owner[n - 1:]
    key, some = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=bool)
    for j in range(n):
        key = key * k + inverse[j:j + m]
        some |= codes[j:j + m] != 0
    inside &= some
    key, owner = key[inside], owner[:m][inside]
    found, number = _small_unique(key) if k ** n <= 1 << 22 else np.unique(key, return_inverse=True)
    digits = np.empty((len(found), n), dtype=np.int64)
    rest = found
    for j in range(n - 1, -1, -1):
        digits[:, j] = present[rest % k]
        rest = rest // k
    return digits, number, owner


def bind(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The vectors of n-grams: letter vectors rotated by their distance from the end, multiplied."""
    codes, inverse = np.unique(grams, return_inverse=True)
    inverse = inverse.reshape(grams.shape)
    table = np.stack([letter_vector(c, dim) for c in codes.tolist()])
    out, n = table[inverse[:, -1]], grams.shape[1]
    for j in range(n - 1):
        out = out * np.roll(table, n - 1 - j, axis=1)[inverse[:, j]]
    return out


def bundle(texts: list[str], groups: np.ndarray, n_groups: int, n: int = 3, dim: int = DIM) -> np.ndarray:
    """Sums of the n-gram vectors of all texts of a group, one row per group (whole numbers)."""
    codes, owner = symbols(texts)
    grams, number, owner = ngrams(codes, owner, n)
    owner = np.asarray(groups)[owner]
    exact = np.float32 if len(owner) < 1 << 24 else np.float64
    out = np.zeros((n_groups, dim))
    for lo in range(0, len(grams), BLOCK):
        width = min(BLOCK, len(grams) - lo)
        here = slice(None) if width == len(grams) else (number >= lo) & (number < lo + width)
        counts = np.bincount(owner[here] * width + (number[here] - lo), minlength=n_groups * width)
        out += counts.reshape(n_groups, width).astype(exact) @ bind(grams[lo:lo + width], dim).astype(exact)
    return out


def tiles(texts: list) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of bounded characters and rows; a longer text is a stretch of its own."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > start and (chars + size > TILE_CHARS or i - start >= TILE_ROWS):
            yield start, i
            start, chars = i, 0
        chars += size
    if start < len(texts):
        yield start, len(texts)


def held_out(id_: Column, folds: int = 3, fold: int = 1) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def _sum_profiles(n: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()),
                                              pa.array([v.astype(np.int64) for v in sums.values()], type=pa.list_(pa.int64()))],
                                             ["lang", "vec"])
            sums.clear()
            return out

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tiles(texts):
                names = sorted(set(langs[a:b]))
                at = {x: i for i, x in enumerate(names)}
                got = bundle(texts[a:b], np.array([at[x] for x in langs[a:b]]), len(names), n, dim)
                for x, v in zip(names, got):
                    sums[x] = sums[x] + v if x in sums else v
                if len(sums) >= FLUSH:
                    yield rows()
        if sums:
            yield rows()
    return run


def learn_prototypes(train: DataFrame, lang: Column, text: Column, n: int = 3, dim: int = DIM) -> list[Row]:
    """(lang, vec) of every language with a letter in its training texts, by language name."""
    labelled = train.select(lang.alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    parts = labelled.mapInArrow(_sum_profiles(n, dim), "lang string, vec array<long>")
    sums = parts.select("lang", F.posexplode("vec").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    whole = (sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))      # DIM entries a language
             .select("lang", F.col("s.v").alias("vec")).where(F.exists("vec", lambda v: v != 0)))
    scratch = Scratch(train.sparkSession, "language")
    kept = scratch.write(whole, "prototypes")
    if kept.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = sorted(kept.collect(), key=lambda r: r.lang)
    scratch.drop(kept)
    return out


def compare(shared: Broadcast, n: int, dim: int):
    """Pandas UDF: (language, cosine) of the nearest prototype of each text; ties go to the first name."""
    @F.pandas_udf("struct<lang: string, score: double>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        for texts in batches:
            texts = [t or "" for t in texts.to_list()]
            lang, score = [], []
            for a, b in tiles(texts):
                v = bundle(texts[a:b], np.arange(b - a), b - a, n, dim)
                size = np.linalg.norm(v, axis=1)
                cos = (v @ unit.T) / np.maximum(size, 1e-300)[:, None] if names else np.zeros((b - a, 1))
                best = cos.argmax(axis=1)
                known = (size > 0) & bool(names)
                lang += [names[i] if k else UNDETERMINED for i, k in zip(best.tolist(), known.tolist())]
                score += np.where(known, np.clip(cos[np.arange(b - a), best], 0.0, 1.0), 0.0).tolist()
            yield pd.DataFrame({"lang": lang, "score": score})
    return nearest


def identify(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", folds: int = 3, fold: int = 1,
             n: int = 3, dim: int = DIM) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; prototypes come from rows that are not held out and name a language.

    Defined cases: a null text or one without a letter (empty, digits, signs) is
    ``und`` with score 0, as is every text where no language was learned; rows
    without a language are no training rows; a null id counts as the empty text in
    the fold; repeated rows count each time; equal cosines go to the first name in
    code point order; a negative cosine scores 0; letters of any script count, as
    lower-cased by Unicode; an input column named like an added one gives way; an
    empty table gives an empty one.
    """
    rows = pack(docs, held=held_out(docs[id_col], folds, fold), text=docs[text], lang=docs[lang].cast("string"))
    learned = learn_prototypes(rows.where(~F.col("held")), F.col("lang"), F.col("text"), n, dim)
    unit = np.array([r.vec for r in learned], dtype=np.float64).reshape(len(learned), dim)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    shared = docs.sparkSession.sparkContext.broadcast(([r.lang for r in learned], unit.astype(np.float32)))
    out = rows.withColumn("_p", compare(shared, n, dim)("text")).select(
        "_row", F.col("held").alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
    return unpack(out, docs.columns, ADDED)
