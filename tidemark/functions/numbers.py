"""Number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding, so that a value halfway between two numbers goes up however it was computed.
NUDGE = 1e-9


def rounded(value: Column | str, places: int) -> Column:
    return F.round((F.col(value) if isinstance(value, str) else value) + NUDGE, places)
