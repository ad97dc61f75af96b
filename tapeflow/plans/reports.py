"""Report frames (R1–R9): the data behind each chart, for all requested
tickers at once (no drawing).  Pass ``tickers`` to restrict to a watchlist
(F7, a semi-join; broadcast when the list is small)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions import metrics as M
from tapeflow.functions.calendar import to_minute
from tapeflow.operators.candles import (
    calendar_gaps, candle_geometry, indicator_candles, stacked_candles, with_daily)
from tapeflow.operators.joins import keep_keys
from tapeflow.operators.rollup import rollup_candles, rollup_stacked
from tapeflow.operators.windows import last_session, latest_sessions

CANDLE_DAYS = 60
PRICE_DAYS = 59


def _days(sessions: DataFrame | None, tickers: DataFrame | None) -> DataFrame | None:
    return None if sessions is None else _watch(sessions, tickers)


def _buy_power(intraday: DataFrame | None, tickers: DataFrame | None,
               sessions: DataFrame | None, rollup: DataFrame | None) -> DataFrame:
    """Latest 60 buy-power candles, from the stored candle states if given."""
    if rollup is not None:
        return rollup_candles(_watch(rollup, tickers), "i_buy_pow", latest=CANDLE_DAYS)
    return indicator_candles(_watch(intraday, tickers), "i_buy_pow", latest=CANDLE_DAYS,
                             index=_days(sessions, tickers))


def _watch(df: DataFrame, tickers: DataFrame | None) -> DataFrame:
    return df if tickers is None else keep_keys(df, tickers, "ticker")


def stock_buy_power_candles(intraday: DataFrame | None, daily: DataFrame,
                            tickers: DataFrame | None = None,
                            sessions: DataFrame | None = None,
                            rollup: DataFrame | None = None) -> DataFrame:
    """Latest 60 buy-power candles per ticker + that day's net inflow."""
    return with_daily(_buy_power(intraday, tickers, sessions, rollup), daily, ["i_entered_money"])


def stock_price_candles(daily: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """R2: latest 59 daily price candles (close := last trade) + volume."""
    d = latest_sessions(_watch(daily, tickers), PRICE_DAYS)
    return d.select("ticker", "date", "high", "low", "open",
                    F.col("last").alias("close"), "volume")


def stock_per_capita_candles(intraday: DataFrame | None, daily: DataFrame,
                             tickers: DataFrame | None = None,
                             sessions: DataFrame | None = None,
                             rollup: DataFrame | None = None) -> DataFrame:
    """Latest 60 buy and sell per-capita candles (one aggregation, long
    form with an ``indicator`` column) + that day's volume."""
    values = ["i_buy_per_capita", "i_sell_per_capita"]
    if rollup is not None:
        c = rollup_stacked(_watch(rollup, tickers), values, latest=CANDLE_DAYS)
    else:
        c = stacked_candles(_watch(intraday, tickers), values, latest=CANDLE_DAYS,
                            index=_days(sessions, tickers))
    return with_daily(c, daily, ["volume"])


def stock_last_session(intraday: DataFrame, tickers: DataFrame | None = None,
                       sessions: DataFrame | None = None) -> DataFrame:
    """Every capture of each ticker's latest session."""
    rows = last_session(_watch(intraday, tickers), ["ticker"], index=_days(sessions, tickers))
    return rows.select("ticker", "timestamp", to_minute("timestamp").alias("minute"),
                       "last_percent", "i_buy_pow", "i_buy_per_capita",
                       "i_sell_per_capita", "i_entered_money")


def stock_valuation(daily: DataFrame, tickers: DataFrame | None = None,
                    display: bool = False) -> DataFrame:
    """Latest eps, P/E and transaction values per ticker.

    ``display`` adds the values rounded to 2 digits for on-screen use (M14).
    """
    last = latest_sessions(_watch(daily, tickers), 1)
    out = last.select(
        "ticker", "date", "eps",
        M.price_earnings("last", "eps").alias("pe"),
        M.transaction_value("volume", "close").alias("trade_value"),
        M.transaction_value("average_volume", "close").alias("avg_trade_value"))
    if display:
        out = out.select("*", *[M.display_round(c).alias(f"{c}_display")
                                for c in ("pe", "trade_value", "avg_trade_value")])
    return out


def market_candles(index_flow: DataFrame | None, rollup: DataFrame | None = None) -> DataFrame:
    """Latest 60 candles of buy power and both per-capitas per universe."""
    values = ["i_buy_pow", "i_buy_per_capita", "i_sell_per_capita"]
    if rollup is not None:
        return rollup_stacked(rollup, values, ["universe"], CANDLE_DAYS)
    return stacked_candles(index_flow, values, keys=["universe"], latest=CANDLE_DAYS)


def market_last_session(index_flow: DataFrame) -> DataFrame:
    """Every capture of each universe's latest session."""
    rows = last_session(index_flow, ["universe"])
    return rows.select("universe", "timestamp", to_minute("timestamp").alias("minute"),
                       "i_buy_pow", "i_buy_per_capita", "i_sell_per_capita", "i_entered_money")


def screened_candles(survivors: DataFrame, intraday: DataFrame | None, daily: DataFrame,
                     sessions: DataFrame | None = None,
                     rollup: DataFrame | None = None) -> DataFrame:
    """Buy-power candles (latest 60) + volume for screen survivors.  The
    survivors are used more than once: pass them staged (``session.staged``)."""
    c = _buy_power(intraday, survivors.select("ticker"), sessions, rollup)
    return with_daily(c, daily, ["volume"])


def candle_calendar_gaps(candles: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """R9 for any candle frame: the days without a candle between a key's
    first and last one, with Jalali fields."""
    return calendar_gaps(candles.select(*keys, "date").distinct(), list(keys))


def price_candle_geometry(daily: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """M16 over R2."""
    return candle_geometry(stock_price_candles(daily, tickers))


def price_calendar_gaps(daily: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Non-trading days inside each ticker's history, with Jalali fields."""
    return calendar_gaps(_watch(daily, tickers).select("ticker", "date"), ["ticker"])
