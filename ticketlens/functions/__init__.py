"""Column expressions (pure ``pyspark.sql.functions`` compositions, no UDFs).

The reference relies on pandas null behaviour; these helpers restate it for
Spark: comparisons with a missing value are false, ``clip`` keeps missing
values, and ``astype(str)`` renders a missing value as the text ``nan``.
"""

from ticketlens.functions.nullsafe import as_text, clip, clip_lower, flag  # noqa: F401
from ticketlens.functions.timeparts import (  # noqa: F401
    datetime_parts, days_between, hours_between, micros_between, minutes_between, weekday_name)
from ticketlens.functions.text import (  # noqa: F401
    contains_any, has_remarks_flag, lower_text, text_length)
from ticketlens.functions.category import combined, complexity, status_label  # noqa: F401
