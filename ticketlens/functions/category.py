"""Category expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens.functions.nullsafe import _c, as_text

# --- fixed values: issue complexity per category (exact, case-sensitive); default 1 ---
COMPLEXITY = {"Technical": 3, "Billing": 2, "Shipping": 2, "Product": 1, "Account": 1}
COMPLEXITY_DEFAULT = 1

# --- fixed values: labels of the 0/1 delay flag ---
STATUS_LABELS = {1: "Delayed", 0: "On-time"}


def combined(a, b, sep: str = " - ") -> Column:
    return F.concat(as_text(a), F.lit(sep), as_text(b))


def complexity(col, mapping: dict[str, int] = COMPLEXITY, default: int = COMPLEXITY_DEFAULT) -> Column:
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(col)), F.lit(default)).cast("int")


def status_label(col, labels: dict[int, str] = STATUS_LABELS) -> Column:
    c = _c(col)
    out = None
    for k, v in labels.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out
