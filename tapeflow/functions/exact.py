"""Sums of doubles that do not depend on the order of the rows.

A value below 2^31 is cut into its whole part and two parts of 26 bits, all
integers.  Their sums are exact in any order and add up over any split of the
rows (2^31 rows at least before a long overflows, which is an error, never a
wrong sum).  A value of 1 or more is kept whole; what a smaller one has beyond
2^-52 is rounded row by row.  Values from 2^31 on (the stored INT columns hold
none) and non-finite ones are added as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = ("w", "m", "l", "x")  # whole, middle, low part; values out of range
_CUT = float(1 << 26)


def exact_sum_parts(value: Column, name: str) -> list[Column]:
    """Aggregates ``<name>_w … <name>_x``: the parts' sums of a group's rows."""
    small = F.abs(value) < float(1 << 31)
    whole = F.floor(value)
    rest = (value - whole) * _CUT
    middle = F.floor(rest)
    low = F.rint((rest - middle) * _CUT).cast("long")
    return [F.sum(F.when(small, c)).alias(f"{name}_{limb}")
            for limb, c in zip(LIMBS, (whole, middle, low))] \
        + [F.sum(F.when(~small, value)).alias(f"{name}_x")]


def part_names(name: str) -> list[str]:
    """The columns ``exact_sum_parts`` makes; sums of them are parts again."""
    return [f"{name}_{limb}" for limb in LIMBS]


def exact_sum(name: str) -> Column:
    """The sum as a double; NULL if there was no value."""
    w, m, low, x = (F.col(c) for c in part_names(name))
    # Carries first, so that each part is small beside the next one.
    m2 = m + F.expr(f"{name}_l div {1 << 26}")
    total = (w + F.expr(f"({name}_m + {name}_l div {1 << 26}) div {1 << 26}")) \
        + (m2 % (1 << 26) + (low % (1 << 26)) / _CUT) / _CUT
    return F.when(x.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + x)
