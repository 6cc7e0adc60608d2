"""Small awkward inputs shared by the operator tests."""

import random

CLASHING = ["size", "id", "key", "h", "f", "_row", "fp", "base", "kept", "taken", "host", "rule", "source_size", "gone"]


def odd_docs(spark, rows=None):
    """Documents with nulls everywhere, empty texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 900}" for i in range(20_000))
    rows = rows or [
        (None, None, None), (None, "", "a"), (1, None, "b"), (2, "", None), (3, "One two three.\nOne two three.\n\nFour", "a"),
        (3, "One two three.\nOne two three.\n\nFour", "a"), (3, "another text under the same id", "a"), (4, long, "a"),
        (5, "   \n\t\n ", "b"), (6, "ÀÉ ümlaut 漢字 😀 <|im_end|> <\\|x|>", "ü"), (None, "text without an id", "b")]
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.selectExpr("*", f"cast('x' as string) as `{c}`")
    return df


def no_docs(spark):
    return odd_docs(spark).where("false")


def prose(rng: random.Random, n: int, stock: int = 400) -> str:
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))
