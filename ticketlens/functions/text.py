"""Free-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.nullsafe import _c, as_text, flag

# --- fixed values: default urgency keywords (plain substring match, any case) ---
URGENT_KEYWORDS = ["urgent", "immediately", "asap", "emergency", "critical", "important"]


def text_length(col) -> Column:
    """Length in code points of the text rendering (missing -> ``nan`` -> 3)."""
    return F.length(as_text(col))


def lower_text(col) -> Column:
    return F.lower(as_text(col))


def contains_any(col, keywords: list[str] = URGENT_KEYWORDS) -> Column:
    """1 when the lower-cased text contains any keyword as a substring, else 0.

    A chain of ``contains`` stays inside whole-stage codegen and avoids a
    regular expression scan per row.
    """
    low = lower_text(col)
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | low.contains(kw.lower())
    return flag(cond)


def has_remarks_flag(col, missing_text: str = "Unknown") -> Column:
    """0 when the text equals the fill marker exactly, else 1 (NULL gives 1)."""
    return F.when(_c(col) == missing_text, F.lit(0)).otherwise(F.lit(1))
