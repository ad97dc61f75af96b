"""Fixed StructTypes of the tables (S4, S5, index flow, snapshot)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, F, I, L = T.StringType(), T.DoubleType(), T.FloatType(), T.IntegerType(), T.LongType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Normalised whole-market snapshot (S2 output).  ``download`` is the capture
# time already converted to the Gregorian calendar (see calendar.parse_download).
SNAPSHOT = _struct(
    ("ticker", S), ("trade_type", S), ("market", S), ("time", S),
    ("download", T.TimestampNTZType()),
    ("open", D), ("high", D), ("low", D), ("close", D), ("final", D),
    ("day_ul", D), ("day_ll", D),
    ("close_percent", F), ("final_percent", F), ("volume", L),
    ("vol_buy_r", D), ("vol_sell_r", D), ("vol_buy_i", D), ("vol_sell_i", D),
    ("no_buy_r", D), ("no_sell_r", D), ("eps", I),
)

# One row per (ticker, session date).
DAILY_FLOW = _struct(
    ("ticker", S), ("date", T.DateType()),
    ("i_buy_pow", F), ("i_buy_per_capita", I), ("i_sell_per_capita", I),
    ("last", I), ("last_percent", F), ("close", I), ("close_percent", F),
    ("volume", L), ("average_volume", L), ("i_entered_money", I), ("eps", I),
    ("i_buy_ratio", F), ("i_sell_ratio", F),
    ("open", I), ("high", I), ("low", I), ("up_level", I), ("dawn_level", I),
)

# S5 as first created (8 value columns) and after the additive evolution.
INTRADAY_FLOW_V1 = _struct(
    ("ticker", S), ("timestamp", T.TimestampNTZType()),
    ("last_price", I), ("i_buy_pow", F), ("i_buy_per_capita", I),
    ("i_sell_per_capita", I), ("i_entered_money", I),
    ("i_buy_ratio", F), ("i_sell_ratio", F),
)
INTRADAY_FLOW = T.StructType(INTRADAY_FLOW_V1.fields + [
    T.StructField("last_percent", F, True), T.StructField("volume", L, True)])

# Market-wide series, one row per (universe, capture).
INDEX_FLOW = _struct(
    ("universe", S), ("timestamp", T.TimestampNTZType()),
    ("i_buy_pow", F), ("i_buy_per_capita", I), ("i_sell_per_capita", I),
    ("i_entered_money", I),
)

DAILY_KEYS = ["ticker", "date"]
INTRADAY_KEYS = ["ticker", "timestamp"]
INDEX_KEYS = ["universe", "timestamp"]
