"""Stored-row projections and market-wide aggregates (M7, M8, A1, A2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.functions import metrics as M
from tapeflow.functions.exact import exact_sum, exact_sum_parts, part_names
from tapeflow.operators.joins import drop_keys, keep_keys
from tapeflow.operators.windows import latest_per_key, with_average_volume


def daily_rows(snapshot: DataFrame) -> DataFrame:
    """M7 without the average: the 19 stored columns of one session.

    Rename trap kept on purpose: snapshot ``close`` (last trade) is stored
    as ``last``; snapshot ``final`` (official close) is stored as ``close``.
    """
    return snapshot.select(
        M.clean_ticker("ticker").alias("ticker"),
        F.to_date("download").alias("date"),
        M.to_float(M.buy_power()).alias("i_buy_pow"),
        M.to_int(M.buy_per_capita()).alias("i_buy_per_capita"),
        M.to_int(M.sell_per_capita()).alias("i_sell_per_capita"),
        M.to_int("close").alias("last"),
        M.to_float("close_percent").alias("last_percent"),
        M.to_int("final").alias("close"),
        M.to_float("final_percent").alias("close_percent"),
        M.to_bigint("volume").alias("volume"),
        M.to_int(M.entered_money()).alias("i_entered_money"),
        M.to_int("eps").alias("eps"),
        M.to_float(M.buy_ratio()).alias("i_buy_ratio"),
        M.to_float(M.sell_ratio()).alias("i_sell_ratio"),
        M.to_int("open").alias("open"),
        M.to_int("high").alias("high"),
        M.to_int("low").alias("low"),
        M.to_int("day_ul").alias("up_level"),
        M.to_int("day_ll").alias("dawn_level"),
    )


DAILY_ORDER = ["ticker", "date", "i_buy_pow", "i_buy_per_capita", "i_sell_per_capita",
               "last", "last_percent", "close", "close_percent", "volume", "average_volume",
               "i_entered_money", "eps", "i_buy_ratio", "i_sell_ratio",
               "open", "high", "low", "up_level", "dawn_level"]


def daily_series(snapshots: DataFrame, n: int = 42) -> DataFrame:
    """Daily table built in one pass from many captures: the last capture of
    each (ticker, date) → M7, with W2 over the rebuilt series."""
    snap = snapshots.withColumn("ticker", M.clean_ticker("ticker")) \
        .withColumn("_d", F.to_date("download"))
    last = latest_per_key(snap, ["ticker", "_d"], "download", 1).drop("_d")
    return with_average_volume(daily_rows(last), n).select(*DAILY_ORDER)


def to_intraday_flow(snapshot: DataFrame) -> DataFrame:
    """M8: one intraday row per capture and ticker (10 value columns)."""
    return snapshot.select(
        M.clean_ticker("ticker").alias("ticker"),
        F.col("download").alias("timestamp"),
        M.to_int("close").alias("last_price"),
        M.to_float(M.buy_power()).alias("i_buy_pow"),
        M.to_int(M.buy_per_capita()).alias("i_buy_per_capita"),
        M.to_int(M.sell_per_capita()).alias("i_sell_per_capita"),
        M.to_int(M.entered_money()).alias("i_entered_money"),
        M.to_float(M.buy_ratio()).alias("i_buy_ratio"),
        M.to_float(M.sell_ratio()).alias("i_sell_ratio"),
        M.to_float("close_percent").alias("last_percent"),
        M.to_bigint("volume").alias("volume"),
    )


# Sums and counts that the market series are made of; adding them up over any
# split of a capture's rows gives the whole capture, to the last digit.
INDEX_PARTS = (*part_names("_buy"), "_buy_n", *part_names("_sell"), "_sell_n",
               *part_names("_money"))


def _index_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *exact_sum_parts(M.buy_per_capita(), "_buy"), F.count(M.buy_per_capita()).alias("_buy_n"),
        *exact_sum_parts(M.sell_per_capita(), "_sell"),
        F.count(M.sell_per_capita()).alias("_sell_n"),
        *exact_sum_parts(M.entered_money(), "_money"))


def _index_rows(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1 rows from whole sums: ratio of averages (not average of ratios),
    rounded after."""
    buy = exact_sum("_buy") / F.nullif(F.col("_buy_n"), F.lit(0))
    sell = exact_sum("_sell") / F.nullif(F.col("_sell_n"), F.lit(0))
    g = sums.select(*keys, buy.alias("_b"), sell.alias("_s"), exact_sum("_money").alias("_m"))
    return g.select(
        *[F.col(k) for k in keys if k != "download"],
        F.col("download").alias("timestamp"),
        M.to_float(F.col("_b") / F.nullif(F.col("_s"), F.lit(0))).alias("i_buy_pow"),
        M.to_int("_b").alias("i_buy_per_capita"),
        M.to_int("_s").alias("i_sell_per_capita"),
        M.to_int("_m").alias("i_entered_money"),
    )


def finish_index(parts: DataFrame, keys: Sequence[str] = ("universe", "download")) -> DataFrame:
    """A1 rows from partial sums."""
    return _index_rows(parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in INDEX_PARTS)), keys)


def _index_aggregate(df: DataFrame, keys: list[str]) -> DataFrame:
    return _index_rows(_index_parts(df, keys), keys)


def index_flow(snapshot: DataFrame, universe: str = "market",
               exclude: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """A1/A2: one market-wide row per capture for one universe.

    ``groupBy(download)`` runs as partial + final aggregation: each map
    task pre-aggregates its share of a capture, so a whole-market capture
    never lands on one task as raw rows.
    """
    df = snapshot
    if exclude is not None:
        df = drop_keys(df, exclude)
    if only is not None:
        df = keep_keys(df, only)
    return _index_aggregate(df.withColumn("universe", F.lit(universe)), ["universe", "download"])


def with_universes(snapshot: DataFrame, block_list: DataFrame, basket: DataFrame) -> DataFrame:
    """Each row once for each universe it belongs to: "market" unless blocked;
    also "large" if in the basket and not blocked.  Each list has one row per
    ticker; it is broadcast by size (planner estimate or AQE's runtime
    measurement), never by a blind hint."""
    blocked = block_list.select("ticker").distinct().withColumn("_blocked", F.lit(True))
    large = basket.select("ticker").distinct().withColumn("_large", F.lit(True))
    tagged = snapshot.join(blocked, "ticker", "left").join(large, "ticker", "left")
    universes = F.filter(
        F.array(F.when(F.col("_blocked").isNull(), F.lit("market")),
                F.when(F.col("_blocked").isNull() & F.col("_large").isNotNull(), F.lit("large"))),
        lambda u: u.isNotNull())
    return tagged.withColumn("universe", F.explode(universes)).drop("_blocked", "_large")


def index_flows(snapshot: DataFrame, block_list: DataFrame, basket: DataFrame) -> DataFrame:
    """A1 and A2 in one pass: one aggregation keyed by (universe, capture)."""
    return _index_aggregate(with_universes(snapshot, block_list, basket), ["universe", "download"])


def index_parts(snapshot: DataFrame, block_list: DataFrame, basket: DataFrame) -> DataFrame:
    """Partial sums of A1 and A2 for a part of the captures' rows."""
    return _index_parts(with_universes(snapshot, block_list, basket), ["universe", "download"])
