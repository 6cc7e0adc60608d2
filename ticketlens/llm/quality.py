"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation
over the counts of vote patterns estimates how often each rule votes what in
good and in bad documents; a document is kept when the posterior probability
that it is good reaches a threshold, so one failed rule alone need not reject it.

Features of a text are counted in one Arrow UDF; patterns are counted by Spark
(at most 2 or 3 votes to the power of the rules, in practice some hundreds) and only those counts reach the
driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import Scratch, pack, unpack

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
            "n_distinct", "n_exclaim", "n_marks", "n_plain"]
_WINDOW = 5
#: a word of letters (any byte above ASCII counts), hyphens and apostrophes with at most one mark behind it
_PLAIN = re.compile(rb"(?<![^ \t\n\x0b\x0c\r])[A-Za-z\x80-\xff'-]+[.,;:!?]?(?![^ \t\n\x0b\x0c\r])")


def _byte_set(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_SPACE, _SYMBOL, _MARK = _byte_set(b" \t\n\x0b\x0c\r"), _byte_set(b"#*$%&|<>"), _byte_set(b".,;:!?")
_POINT = ~np.isin(np.arange(256), np.arange(0x80, 0xC0))             # bytes that begin a code point
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(0x61, 0x7B)) | (np.arange(256) >= 0xC0)


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, the first place included."""
    grams = list(zip(*[words[i:] for i in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    seen: set = set()
    twice = set()
    for g in grams:
        if g in seen:
            twice.add(g)
        else:
            seen.add(g)
    total = end = 0
    for i, g in enumerate(grams):
        if g in twice:
            total += i + window - max(i, end)
            end = i + window
    return total


def text_features(raw: bytes) -> tuple:
    words = raw.split()                               # bytes.split() splits at exactly \x20 and \x09-\x0D
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), int(count[_POINT & ~_SPACE].sum()), int(count[_SYMBOL].sum()), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), int(count[_LETTER].sum()), int(count[_UPPER].sum()), len(set(words)),
            int(count[0x21]), int(count[_MARK].sum()), len(_PLAIN.findall(raw)))


@F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in FEATURES]))
def _features(raw: pa.Array) -> pa.Array:
    cols = list(zip(*[text_features(x.as_py()) for x in raw])) or [()] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], FEATURES)


def features(text: Column) -> Column:
    """Struct of counts over the whole text; a null text has none of anything."""
    return _features(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def _rules(f: Column) -> list[tuple[str, Column, Column]]:
    """(name, votes bad if, votes good if) in the order of ``RULES``; otherwise the rule abstains.

    Most rules know one kind of junk and say nothing about a text that hasn't it.
    """
    n, letters, never = f["n_words"], f["n_letters"], F.lit(False)
    return [
        ("length", n < 10, never),
        ("symbols", f["n_symbols"] * 10 > n, never),
        ("letters", letters * 4 < f["word_chars"] * 3, never),
        ("plain", f["n_plain"] * 10 < n * 7, (f["n_plain"] * 10 >= n * 9) & (n > 0)),
        ("case", f["n_upper"] * 2 > letters, never),
        ("word_length", (f["word_chars"] < 3 * n) | (f["word_chars"] > 10 * n), never),
        ("lines", f["n_dup_lines"] * 10 > f["n_lines"] * 3, never),
        ("repeats", f["n_repeat_words"] * 5 > n, never),
        ("variety", f["n_distinct"] * 5 < n, never),
        ("exclamations", f["n_exclaim"] * 5 > n, never),
        ("punctuation", ((f["n_marks"] * 100 < n) & (n >= 50)) | (f["n_marks"] > n), never),
    ]


RULES = ["length", "symbols", "letters", "plain", "case", "word_length", "lines", "repeats", "variety", "exclamations",
         "punctuation"]


def votes(f: Column) -> list[Column]:
    return [F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)) for _, bad, good in _rules(f)]


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 200, strength: float = 0.02,
              prior: float = 0.8, accuracy: float = 0.9) -> dict:
    """EM over (votes, count) pairs: ``prior`` (share of good documents) and each rule's ``accuracy``.

    A rule that votes names the true class with its accuracy, and abstaining
    says nothing.  Accuracies and prior start from, and are drawn by ``strength``
    times all rows towards, the given values; that fixes which class is which,
    and they stay within 0.5 and 0.995.  Without rows the given values return.
    """
    k = len(RULES)
    acc, good = np.full(k, accuracy), prior
    if patterns:
        v = np.array([p for p, _ in patterns])                           # [pattern, rule]
        n = np.array([c for _, c in patterns], float)
        weight = strength * n.sum()
        for _ in range(rounds):
            odds = math.log(good / (1 - good)) + v @ np.log(acc / (1 - acc))
            post = 1 / (1 + np.exp(-odds))                               # P(good | votes)
            right = (n * post) @ (v > 0) + (n * (1 - post)) @ (v < 0)
            new = np.clip((right + weight * accuracy) / (n @ (v != 0) + weight), 0.5, 0.995)
            good = float(((n * post).sum() + weight * prior) / (n.sum() + weight))
            done, acc = np.abs(new - acc).max() < 1e-10, new
            if done:
                break
    return {"prior": good, "accuracy": [float(a) for a in acc]}


def posterior(vote_cols: list[Column], model: dict) -> Column:
    """P(good | votes) under a fitted model, as a column."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for col, a in zip(vote_cols, model["accuracy"]):
        odds = odds + col * math.log(a / (1 - a))
    return 1.0 / (1.0 + F.exp(-odds))


def fit(counted: DataFrame) -> dict:
    """Model from a table with a feature struct column ``f``; only pattern counts reach the driver."""
    names = [f"v{i}" for i in range(len(RULES))]
    got = (counted.select(*[c.alias(x) for c, x in zip(votes(F.col("f")), names)])
           .groupBy(*names).count().collect())                           # at most 3 ** len(RULES) rows
    return fit_votes(sorted((tuple(r[x] for x in names), r["count"]) for r in got))


def base_failed(f: Column, min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (f["n_words"] < min_words) | (f["n_repeat_words"] * 100 > f["n_words"] * max_repeat_percent)


def judge(docs: DataFrame, *, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` plus the feature counts, base_failed, quality (posterior) and kept.

    ``keep_text=False`` leaves the text column out, and the features are then
    counted once and written; otherwise they are counted again beside the text
    rather than shuffled to it.

    Defined cases: a null or empty text has no words and fails the base rule;
    repeated rows are judged alike; an input column named like an added one
    gives way; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    columns = docs.columns
    if keep_text:
        rows = pack(docs, f=features(docs[text]))
        counted = scratch.write(docs.select(features(docs[text]).alias("f")), "features")
        model = fit(counted)
        scratch.drop(counted)
    else:
        columns = [c for c in columns if c != text]
        rows = scratch.write(pack(docs.select(*columns, text), f=features(docs[text])).withColumn(
            "_row", F.struct(*[F.col("_row").getField(c).alias(c) for c in columns])), "features")
        model = fit(rows)
    f = F.col("f")
    rows = (rows.withColumn("quality", posterior(votes(f), model)).withColumn("base_failed", base_failed(f))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
            .select("_row", *[f[x].alias(x) for x in FEATURES], "base_failed", "quality", "kept"))
    return unpack(rows, columns, FEATURES + ["base_failed", "quality", "kept"])
