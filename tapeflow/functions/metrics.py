"""Per-row flow metrics and the narrowing casts of the stored tables.

Every function returns a Column over the normalised snapshot columns
(``vol_buy_r``, ``no_buy_r``, ``final`` …), so the optimizer can share
sub-expressions and keep them inside codegen.  The fixed formulas are
written as SQL expression text (parsed once on the JVM side).  Divisions
follow ``x / NULLIF(y, 0)``: a zero divisor gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeflow.functions.columns import as_col, safe_div

# Money and per-capita figures are reported in units of 10^7
# (rial → million toman); transaction values in units of 10^10.
MONEY_UNIT = 10_000_000
VALUE_UNIT = 10_000_000_000

# M1–M6 as SQL text over the snapshot columns.
BUY_POWER_SQL = "(vol_buy_r / nullif(no_buy_r, 0)) / nullif(vol_sell_r / nullif(no_sell_r, 0), 0)"
BUY_PER_CAPITA_SQL = f"((vol_buy_r * final) / nullif(no_buy_r, 0)) / {MONEY_UNIT}"
SELL_PER_CAPITA_SQL = f"((vol_sell_r * final) / nullif(no_sell_r, 0)) / {MONEY_UNIT}"
ENTERED_MONEY_SQL = f"((vol_sell_i - vol_buy_i) * final) / {MONEY_UNIT}"
BUY_RATIO_SQL = "vol_buy_r / nullif(volume, 0)"
SELL_RATIO_SQL = "vol_sell_r / nullif(volume, 0)"


def buy_power() -> Column:
    """M1: (retail buy volume per buyer) / (retail sell volume per seller)."""
    return F.expr(BUY_POWER_SQL)


def buy_per_capita() -> Column:
    """M2: money bought per retail buyer."""
    return F.expr(BUY_PER_CAPITA_SQL)


def sell_per_capita() -> Column:
    """M3: money sold per retail seller."""
    return F.expr(SELL_PER_CAPITA_SQL)


def entered_money() -> Column:
    """M4: institutional net sale = retail net purchase, in money units."""
    return F.expr(ENTERED_MONEY_SQL)


def buy_ratio() -> Column:
    """M5: retail share of the buy volume."""
    return F.expr(BUY_RATIO_SQL)


def sell_ratio() -> Column:
    """M6: retail share of the sell volume."""
    return F.expr(SELL_RATIO_SQL)


# --- M13 narrowing casts (what a typed INSERT does to a double) -------------

def to_int(c) -> Column:
    """double → INT, rounding half to even (assignment cast)."""
    return F.rint(as_col(c)).cast("int")


def to_bigint(c) -> Column:
    """double → INT8, rounding half to even (assignment cast)."""
    return F.rint(as_col(c)).cast("long")


def to_float(c) -> Column:
    """double → FLOAT4."""
    return as_col(c).cast("float")


def to_long_half_up(c) -> Column:
    """exact numeric → INT8, rounding half away from zero."""
    return F.round(as_col(c)).cast("long")


# --- valuation (M9–M12) -----------------------------------------------------

def price_earnings(last="last", eps="eps") -> Column:
    """M9: last price (as FLOAT4) / eps, as double; NULL when eps = 0."""
    return safe_div(as_col(last).cast("float").cast("double"), as_col(eps).cast("double"))


def transaction_value(volume="volume", close="close") -> Column:
    """Volume × close / 10^10 (close taken as FLOAT4 first)."""
    return as_col(volume).cast("double") * as_col(close).cast("float").cast("double") / VALUE_UNIT


def market_cap(cap="market_cap") -> Column:
    """Market cap / 10^10 as INT8 (only when the snapshot carries it)."""
    return to_bigint(as_col(cap).cast("double") / VALUE_UNIT)


def display_round(c, digits: int = 2) -> Column:
    """Round for display (half even); NULL stays NULL."""
    return F.bround(as_col(c), digits)


# --- M15 ---------------------------------------------------------------------

def clean_ticker(c="ticker") -> Column:
    """Strip white space at both ends, including no-break and other
    Unicode space separators (plain ``trim`` removes only U+0020)."""
    return F.regexp_replace(as_col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
