"""Universe filters on the snapshot.

Exclusions are DELETE-style: a row goes only when the exclusion predicate
is TRUE, so a NULL market or time keeps the row.  Threshold screens (F8)
are WHERE-style: NULL drops the row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions import metrics as M
from tapeflow.operators.joins import drop_keys, keep_keys, ticker_frame

# ---------------------------------------------------------------------------
# The labels and lists the reference filters on, verbatim.
# Trade types dropped: block and bulk trades.
DROP_TRADE_TYPES = ("بلوکی", "عمده")
# Markets dropped: exchange-traded funds and the three rights-issue markets.
DROP_MARKETS = ("صندوق قابل معامله", "حق تقدم بورس", "حق تقدم فرابورس", "حق تقدم پایه")
# The base (OTC) market, dropped by some screens as well.
BASE_MARKET = "پایه"
# Tickers left out of the market-wide series.
MARKET_BLOCK_LIST = (
    "آسیاتک", "پی پاد", "ددانا", "سآبیک", "فرود", "گلدیر", "درازی",
    "فروژ", "وطوبی", "اردستان", "انتخاب", "وکغدیر", "فگستر", "فزر", "فتوسا", "غکورش", "ولکار",
    "ومدیر", "لطیف", "سپید", "وهامون", "مدیریت", "کیمیاتک", "فجهان", "فسبزوار", "توسن",
    "صبا", "غگیلا", "پیزد", "آریا", "وپویا", "سیتا", "ولپارس", "رافزا", "آبادا", "بگیلان",
    "غزر", "شاروم", "امین", "زملارد", "گدنا", "ثبهساز", "بپیوند", "ثامید",
    "وسپهر", "چخزر", "بوعلی", "وکبهمن", "سپیدار",
    "کزغال", "اپال", "ساوه", "زکوثر", "شصدف", "کصدف",
)
# The large-cap basket of the second market series.
LARGE_CAP_BASKET = (
    "فارس", "فولاد", "فملی", "کگل", "شستا", "شپنا", "شبندر",
    "شتران", "وبملت", "خودرو", "خساپا", "وتجارت", "وبصادر",
)
SESSION_START = "09:00:00"
SESSION_END = "14:00:00"
# ---------------------------------------------------------------------------


def block_list(spark: SparkSession, tickers: Iterable[str] = MARKET_BLOCK_LIST) -> DataFrame:
    """F5 list as a table (default: the reference's fixed list)."""
    return ticker_frame(spark, tickers)


def large_cap_basket(spark: SparkSession, tickers: Iterable[str] = LARGE_CAP_BASKET) -> DataFrame:
    """F6 list as a table (default: the reference's fixed basket)."""
    return ticker_frame(spark, tickers)


def _exclude(df: DataFrame, pred: Column) -> DataFrame:
    return df.filter(~F.coalesce(pred, F.lit(False)))


def outside_universe(trade_types: Iterable[str] = DROP_TRADE_TYPES,
                     markets: Iterable[str] = DROP_MARKETS, drop_base: bool = False) -> Column:
    """F1 (and F2 with ``drop_base``): block/bulk trades, funds and rights."""
    markets = tuple(markets) + ((BASE_MARKET,) if drop_base else ())
    return F.col("trade_type").isin(*trade_types) | F.col("market").isin(*markets)


def tradable(df: DataFrame, trade_types: Iterable[str] = DROP_TRADE_TYPES,
             markets: Iterable[str] = DROP_MARKETS, drop_base: bool = False) -> DataFrame:
    """F1 (and F2 with ``drop_base``): drop what is outside the universe."""
    return _exclude(df, outside_universe(trade_types, markets, drop_base))


def in_session(df: DataFrame, start: str = SESSION_START, end: str = SESSION_END) -> DataFrame:
    """drop captures whose last trade is before ``start`` or after ``end``
    (both ends kept; ``time`` is fixed-width ``HH:mm:ss``)."""
    t = F.col("time")
    return _exclude(df, (t < F.lit(start)) | (t > F.lit(end)))


def has_opened(df: DataFrame) -> DataFrame:
    """drop instruments that have not traded today (``open = 0``)."""
    return _exclude(df, F.col("open") == 0)


def exclude_tickers(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """drop listed tickers (anti-join; broadcast when the list is small)."""
    return drop_keys(df, tickers, "ticker")


def only_tickers(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """keep listed tickers (semi-join; broadcast when the list is small)."""
    return keep_keys(df, tickers, "ticker")


def strong_flow(min_pow: float, min_buy: float, min_sell: float,
                max_sell: float | None = None) -> Column:
    """F8: buy power ≥ ``min_pow``, buy per capita > ``min_buy``,
    ``min_sell`` < sell per capita (< ``max_sell``), on raw doubles."""
    pred = ((M.buy_power() >= min_pow) & (M.buy_per_capita() > min_buy)
            & (M.sell_per_capita() > min_sell))
    if max_sell is not None:
        pred = pred & (M.sell_per_capita() < max_sell)
    return pred


def closes_at_limit(at_limit: bool) -> Column:
    """closing at the upper price limit (or not)."""
    return F.col("close") == F.col("day_ul") if at_limit else F.col("close") != F.col("day_ul")


def traded_below_limit(by: str = "low") -> Column:
    """traded below the upper limit at some point (``low`` or ``open``)."""
    return F.col(by) < F.col("day_ul")
