"""Test adapters: derive the engine's input tables from the driver tables.

The values are deterministic integer/double arithmetic that Spark and
DuckDB evaluate identically (see FIXTURES.md §2).  They exercise the
semantics; they are not realistic prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.columns import idiv
from tapeflow.functions.calendar import with_jalali_fields
from tapeflow.operators.windows import latest_per_key

# Fixed values of the adapter: Persian labels the filters act on.
BLOCK_TRADE = "بلوکی"
NORMAL_TRADE = "عادی"
ETF_MARKET = "صندوق قابل معامله"
BASE_MARKET = "پایه"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot_from_events(events: DataFrame) -> DataFrame:
    """F-1: one snapshot row per event (unique ``ts`` → deterministic order)."""
    stage = events.selectExpr(
        "event_id AS e", "ts", "user_id", "event_type",
        "CAST(round(value * 100) AS BIGINT) AS v",
    ).selectExpr(
        "concat('S', CAST(user_id AS STRING)) AS ticker",
        f"CASE WHEN event_type = 'error' THEN '{BLOCK_TRADE}' ELSE '{NORMAL_TRADE}' END AS trade_type",
        f"CASE pmod(e, 10) WHEN 0 THEN '{ETF_MARKET}' WHEN 1 THEN '{BASE_MARKET}' "
        "WHEN 2 THEN CAST(NULL AS STRING) ELSE 'main' END AS market",
        "date_format(ts, 'HH:mm:ss') AS time",
        "CAST(ts AS TIMESTAMP_NTZ) AS download",
        "CASE WHEN pmod(e, 50) = 0 THEN 0D ELSE CAST(1000 + pmod(v * 7, 400) AS DOUBLE) END AS open",
        "CAST(1000 + pmod(v, 400) AS DOUBLE) AS close",
        "CAST(1000 + pmod(v * 3, 400) AS DOUBLE) AS final",
        "CASE WHEN pmod(e, 2) = 0 THEN CAST(1000 + pmod(v, 400) AS DOUBLE) ELSE 1400D END AS day_ul",
        "900D AS day_ll",
        "CAST(100000 + pmod(e * 7919, 4000000) AS DOUBLE) AS vol_buy_r",
        "CAST(100000 + pmod(e * 104729, 4000000) AS DOUBLE) AS vol_sell_r",
        "CAST(pmod(e * 15485863, 500000) AS DOUBLE) AS vol_buy_i",
        "CAST(pmod(e * 32452843, 500000) AS DOUBLE) AS vol_sell_i",
        "CAST(pmod(e * 31, 17) AS DOUBLE) AS no_buy_r",
        "CAST(pmod(e * 37, 19) AS DOUBLE) AS no_sell_r",
        "CAST((pmod(e, 7) - 1) * 100 AS INT) AS eps",
    )
    return stage.selectExpr(
        "ticker", "trade_type", "market", "time", "download", "open",
        "greatest(open, close, final) + 5 AS high",
        "least(CASE WHEN open = 0 THEN close ELSE open END, close, final) - 5 AS low",
        "close", "final", "day_ul", "day_ll",
        "CAST((close - open) * 100D / nullif(open, 0) AS FLOAT) AS close_percent",
        "CAST((final - open) * 100D / nullif(open, 0) AS FLOAT) AS final_percent",
        "CAST(vol_buy_r + vol_buy_i AS BIGINT) AS volume",
        "vol_buy_r", "vol_sell_r", "vol_buy_i", "vol_sell_i", "no_buy_r", "no_sell_r", "eps",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures (F-1)."""
    return snapshot_from_events(table(spark, sf_dir, "events"))


def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The "current" whole-market snapshot: last F-1 row per ticker."""
    return latest_per_key(snapshots(spark, sf_dir), ["ticker"], "download", 1)


def hourly_cross_sections(snapshot: DataFrame) -> DataFrame:
    """F-3 shaping: every row's ``download`` set to its hour, so that an hour's
    rows are one whole-market cross-section; no row is left out."""
    return snapshot.withColumn("download", F.date_trunc("hour", "download").cast("timestamp_ntz"))


def hourly_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-3 over all captures."""
    return hourly_cross_sections(snapshots(spark, sf_dir))


def ticker_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F-3 lists: block list (user_id % 5 = 0) and large-cap basket (% 5 = 1)."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    t = F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("ticker")
    block = users.filter(F.pmod("user_id", F.lit(5)) == 0).select(t)
    basket = users.filter(F.pmod("user_id", F.lit(5)) == 1).select(t)
    return block, basket


def daily_from_lineitem(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """F-2: a long daily price table, ticker = brand, one row per ship date."""
    li = lineitem.select(
        "l_partkey", F.to_date("l_shipdate").alias("date"), "l_quantity",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    brands = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    g = (li.join(brands, "l_partkey")
           .groupBy("ticker", "date")
           .agg(F.sum("l_quantity").cast("long").alias("volume"),
                F.min("c").alias("lo"), F.max("c").alias("hi"),
                F.count(F.lit(1)).alias("n")))
    lo, hi = F.col("lo"), F.col("hi")
    return g.select(
        "ticker", "date", "volume",
        lo.cast("int").alias("low"), hi.cast("int").alias("high"),
        idiv(lo + hi, 2).cast("int").alias("open"),
        (lo + idiv((hi - lo) * 3, 4)).cast("int").alias("last"),
        (lo + idiv((hi - lo) * 3, 4)).cast("int").alias("close"),
        ((F.pmod(F.col("n"), F.lit(5)) - 1) * 100).cast("int").alias("eps"),
    )


def long_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_from_lineitem(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def order_dates_jalali(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-4 input: every order with its date as Jalali text."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))
    return with_jalali_fields(o, "o_orderdate")
