"""Which timestamp pattern a text column is written in, by a vote of all its texts.

Every candidate pattern counts the texts that it parses, all columns and patterns
in one aggregate.  A text is parsed only by the patterns that have its separators
(a failed attempt costs far more than a comparison), or by all where it has others.  The pattern with the most texts wins, so whether days or months
come first is settled by the texts that only one order can read (a first number
above 12).  Where both read equally many, nothing tells them apart: the
month-first pattern wins, as the reference's parser has it, and the column is
reported as ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: in order of preference; one-digit days, months and hours are read too
CANDIDATES = [d + t for d in ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy")
              for t in (" H:mm:ss", " H:mm", "")]
#: patterns that differ in the order of day and month alone
SWAPPED = {a + t: b + t for x, y in (("M/d/yyyy", "d/M/yyyy"), ("M-d-yyyy", "d-M-yyyy")) for a, b in ((x, y), (y, x))
           for t in (" H:mm:ss", " H:mm", "")}


def separators(pattern: str) -> str:
    """What is left of a text of this pattern without its digits."""
    return "".join(ch for ch in pattern if not ch.isalpha())


KNOWN = sorted({separators(p) for p in CANDIDATES})


def parsed_by(text: Column, shape: Column, pattern: str) -> Column:
    """The text as a timestamp; ``shape`` is the text without digits.

    Digits, separators and signs are all that a candidate reads, and no sign added to one
    candidate's separators gives another's: a known shape needs no other candidate.
    """
    fits = (shape == separators(pattern)) | ~shape.isin(KNOWN)
    return F.when(fits, F.try_to_timestamp(text, F.lit(pattern)))


def text_columns(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]


def infer_formats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, pattern, texts, parsed, ambiguous) of every text column among ``cols``.

    ``pattern`` is null where no candidate reads a single text (all missing, or
    another notation).  Other types need no pattern and have no row.
    """
    cols = text_columns(df, cols)
    spark, schema = df.sparkSession, "column_name string, pattern string, texts long, parsed long, ambiguous boolean"
    if not cols:
        return spark.createDataFrame([], schema)
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    texts = df.select(*[quoted(c).alias(f"t{i}") for i, c in enumerate(cols)])
    texts = texts.withColumns({f"s{i}": F.translate(f"t{i}", "0123456789", "") for i in range(len(cols))})
    aggs = []
    for i in range(len(cols)):
        text, shape = F.col(f"t{i}"), F.col(f"s{i}")
        aggs.append(F.count(text).alias(f"n{i}"))
        aggs += [F.count(parsed_by(text, shape, p)).alias(f"c{i}_{j}") for j, p in enumerate(CANDIDATES)]
    row = texts.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        votes = {p: row[f"c{i}_{j}"] for j, p in enumerate(CANDIDATES)}
        best = max(votes, key=lambda p: votes[p])                 # the first of equals
        if not votes[best]:
            out.append((c, None, row[f"n{i}"], 0, False))
        else:
            out.append((c, best, row[f"n{i}"], votes[best], votes.get(SWAPPED.get(best), -1) == votes[best]))
    return spark.createDataFrame(out, schema)


def inferred(df: DataFrame, cols: list[str], fallback: list[str]) -> tuple[dict[str, list[str]], list[str]]:
    """(patterns per text column for ``convert_datetimes``: the voted one, then ``fallback``; ambiguous columns)."""
    rows = infer_formats(df, cols).collect()                     # one per text column
    return ({r["column_name"]: ([r["pattern"]] if r["pattern"] else []) + fallback for r in rows},
            [r["column_name"] for r in rows if r["ambiguous"]])
