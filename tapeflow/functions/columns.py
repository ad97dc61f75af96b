"""Small Column helpers shared by every module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """Exact integer division (SQL ``div``), returns BIGINT."""
    b = F.lit(b) if isinstance(b, int) else as_col(b)
    return F.call_function("div", as_col(a), b)


def safe_div(a, b) -> Column:
    """``a / NULLIF(b, 0)``: NULL instead of a division-by-zero error."""
    return as_col(a) / F.nullif(as_col(b), F.lit(0))
