"""Date and time expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The layouts tried, in this order, when no layout is given.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "yyyyMMdd",
)


def parse_timestamp(c: Column, fmt: str | None = None, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to timestamp; text in none of the layouts becomes null.

    Without a layout, Spark's own ISO reading (zones, fractions) is tried first. A
    layout is only tried on text of its shape, since a failing parse is costly.
    """
    if fmt:
        return F.try_to_timestamp(c, F.lit(fmt))
    tries = [F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats]
    return F.coalesce(c.try_cast("timestamp"), *tries)


def _shape(fmt: str) -> str:
    """Pattern of the texts a layout can read: a digit per letter."""
    plain = fmt.replace("'T'", "\0")
    return "^" + re.sub(r"[A-Za-z]", r"\\d", plain).replace("\0", "T") + "$"
