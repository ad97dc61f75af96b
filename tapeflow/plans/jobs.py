"""Ingest jobs (I1–I3): snapshot captures → stored history tables.

The reference ran one script per capture, looping over tickers with two
or three SQL statements each.  Here a job is one plan over all tickers
(and any number of captures): filter → project → keyed append.

Tables under one root, changed together by one commit (``sources.versions``):
  daily         partitioned by ``j_year``, ``j_month`` (Jalali month of the session)
  daily_blocks  totals of each ticker's month in daily, partitioned likewise; a batch
                gets its trailing averages from them and from few stored rows
  intraday      partitioned by ``date``
  index         partitioned by ``date``
  rollup        candle states of intraday by (ticker, day), partitioned by ``date``;
                its (ticker, date) pairs are the sessions reports choose days from
  index_rollup  candle states of index by (universe, day), partitioned by ``date``
  quarantine    rows without a usable key, partitioned by ``run``
  landed        the files ``follow`` has ingested (``streaming.follow``)
Key rules are error / skip / replace; a replace rewrites only the partitions
the batch touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.calendar import with_jalali_fields
from tapeflow.functions.metrics import clean_ticker
from tapeflow.operators.blocks import appended_by_blocks, block_totals, months_of
from tapeflow.operators.flows import DAILY_ORDER, daily_rows, index_flows, to_intraday_flow
from tapeflow.operators.universe import (
    block_list as default_block_list, has_opened, in_session, large_cap_basket, tradable)
from tapeflow.operators.rollup import candle_states, merge_states
from tapeflow.operators.windows import (
    appended_average_volume, latest_per_key, with_average_volume)
from tapeflow.schemas import (
    DAILY_FLOW, DAILY_KEYS, INDEX_FLOW, INDEX_KEYS, INTRADAY_FLOW, INTRADAY_KEYS)
from tapeflow.session import staged
from tapeflow.sources.snapshots import quarantine
from tapeflow.sources.versions import Transaction, read_table, version

# The schema a table is read with (None: that of its files).
SCHEMAS = {"daily": DAILY_FLOW, "daily_blocks": None, "intraday": INTRADAY_FLOW, "index": INDEX_FLOW,
           "rollup": None, "index_rollup": None, "quarantine": None, "landed": None}


def ingest_universe(snapshot: DataFrame) -> DataFrame:
    """F1 + F3: the captures every ingest keeps."""
    return in_session(tradable(snapshot))


def daily_load(snapshot: DataFrame, history: DataFrame | None = None, n: int = 42) -> DataFrame:
    """I1 rows: filtered captures (F1, F3, F4) → last capture of each
    (ticker, day) → M7 and W2.  With ``history`` (the stored daily table) the
    trailing averages also see the stored sessions; batch rows stand for
    stored ones of the same key."""
    rows = session_rows(snapshot)
    if history is None:
        return with_average_volume(rows, n).select(*DAILY_ORDER)
    others = history.join(rows.select(*DAILY_KEYS), DAILY_KEYS, "left_anti")
    return appended_average_volume(rows, others, n)[0].select(*DAILY_ORDER)


def session_rows(snapshot: DataFrame) -> DataFrame:
    """I1 rows without W2: the last filtered capture of each (ticker, day)."""
    snap = has_opened(ingest_universe(snapshot)).withColumn("ticker", clean_ticker("ticker")) \
        .withColumn("_d", F.to_date("download"))
    return daily_rows(latest_per_key(snap, ["ticker", "_d"], "download", 1).drop("_d"))


def intraday_load(snapshot: DataFrame) -> DataFrame:
    """I2 rows: filtered captures → M8; repeated keys are left to the sink's
    conflict rule."""
    return to_intraday_flow(ingest_universe(snapshot))


def market_load(snapshot: DataFrame, block_list: DataFrame, basket: DataFrame) -> DataFrame:
    """I3 rows: both market-wide series from the filtered captures."""
    return index_flows(ingest_universe(snapshot), block_list, basket)


def with_session_month(daily: DataFrame) -> DataFrame:
    """The daily table's partition columns: Jalali year and month."""
    return with_jalali_fields(daily, "date", prefix="_").drop("_j_day") \
        .withColumnRenamed("_j_year", "j_year").withColumnRenamed("_j_month", "j_month")


DAILY_PARTITIONS = ["j_year", "j_month"]
# Partition and key columns of the tables that grow run by run.
LAYOUT = {"daily": (DAILY_PARTITIONS, DAILY_KEYS), "intraday": (["date"], INTRADAY_KEYS),
          "index": (["date"], INDEX_KEYS), "landed": ([], ["digest"])}


def stored_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest version under ``root`` (those it has)."""
    at = version(spark, root)
    out = {name: read_table(spark, root, name, schema, at) for name, schema in SCHEMAS.items()}
    out = {name: df for name, df in out.items() if df is not None}
    if "rollup" in out:
        out["sessions"] = out["rollup"].select("ticker", "date")
    return out


def refresh_states(tx: Transaction, flow: str, name: str, keys: list[str], whole: bool) -> None:
    """Bring the candle states of the days that ``tx`` adds to ``flow`` up to
    date.  ``whole``: it wrote all rows of those days, else new ones only."""
    rows = tx.written(flow)
    if rows is None:
        return
    states = candle_states(rows, keys)
    stored = tx.table(name)
    if stored is not None and not whole:
        states = staged(states, "new-states")
        days = states.select("date").distinct()
        states = merge_states(states.unionByName(
            stored.join(days, "date", "left_semi").select(*states.columns)), keys)
    tx.write(name, states, ["date"], keys, replace=True)


def stored_months(tx: Transaction, months: list[tuple[int, int]]) -> DataFrame:
    """Rows of the stored daily table of these months; no other folder is read."""
    rows = tx.table("daily", SCHEMAS["daily"], [f"j_year={y}/j_month={m}" for y, m in months])
    if rows is None:
        rows = tx.table("daily", SCHEMAS["daily"]).limit(0)
    return rows


def daily_into(tx: Transaction, snapshot: DataFrame, on_conflict: str, n: int = 42) -> None:
    """I1 for a batch: its daily rows with averages over stored sessions too,
    and the block totals of its months."""
    rows = with_session_month(session_rows(snapshot))
    if tx.table("daily", SCHEMAS["daily"]) is None:
        rows = staged(with_average_volume(rows, n), "daily-rows")
        totals = block_totals(rows)
    else:
        rows = staged(rows, "daily-rows")
        stored = tx.table("daily_blocks")
        if stored is None:  # a table from before there were block totals
            stored = block_totals(tx.table("daily", SCHEMAS["daily"]))
        if on_conflict == "skip":
            rows = staged(rows.join(stored_months(tx, months_of(rows)).select(*DAILY_KEYS),
                                    DAILY_KEYS, "left_anti"), "new-daily-rows")
        rows, refreshed, totals = appended_by_blocks(
            rows, lambda months: stored_months(tx, months), stored, n, on_conflict == "replace")
        if refreshed is not None:
            refreshed = staged(refreshed.withColumnRenamed("average_volume", "_fresh"),
                               "refreshed-averages")
            months = months_of(with_session_month(refreshed))
            old = stored_months(tx, months).join(refreshed, DAILY_KEYS) \
                .withColumn("average_volume", F.col("_fresh"))
            rows = rows.select(*DAILY_ORDER, *DAILY_PARTITIONS).unionByName(
                old.select(*DAILY_ORDER, *DAILY_PARTITIONS))
    tx.write_unique("daily", rows.select(*DAILY_ORDER, *DAILY_PARTITIONS), DAILY_KEYS,
                    on_conflict, DAILY_PARTITIONS, SCHEMAS["daily"])
    tx.write("daily_blocks", totals, DAILY_PARTITIONS, ["ticker"], replace=True)


def ingest_into(tx: Transaction, snapshot: DataFrame, on_conflict: str = "error",
                block_list: DataFrame | None = None, basket: DataFrame | None = None,
                daily: bool = True, run_id: str | None = None) -> None:
    """I1 (when ``daily``), I2 and I3 for a batch of captures as part of the
    transaction ``tx``, with the candle states (A3) of the days it touches.

    Captures without a usable key go to the quarantine table under ``run_id``.
    With ``replace``, stored sessions whose trailing average the batch changes
    are refreshed too."""
    spark = tx.spark
    block_list = block_list if block_list is not None else default_block_list(spark)
    basket = basket if basket is not None else large_cap_basket(spark)
    # Read and typed once; all tables below start from the staged rows.
    snapshot, rejected = quarantine(staged(snapshot, "staged-captures"))
    if daily:
        daily_into(tx, snapshot, on_conflict)
    intraday = intraday_load(snapshot).withColumn("date", F.to_date("timestamp"))
    tx.write_unique("intraday", intraday, INTRADAY_KEYS, on_conflict, ["date"],
                    SCHEMAS["intraday"])
    index = market_load(snapshot, block_list, basket).withColumn("date", F.to_date("timestamp"))
    tx.write_unique("index", index, INDEX_KEYS, on_conflict, ["date"], SCHEMAS["index"])
    refresh_states(tx, "intraday", "rollup", ["ticker"], on_conflict == "replace")
    refresh_states(tx, "index", "index_rollup", ["universe"], on_conflict == "replace")
    run_id = run_id or uuid.uuid4().hex
    tx.clear("quarantine", f"run={run_id}")
    tx.write("quarantine", rejected.withColumn("run", F.lit(run_id)), ["run"])


def run_ingest(spark: SparkSession, snapshot: DataFrame, root: str, on_conflict: str = "error",
               block_list: DataFrame | None = None, basket: DataFrame | None = None,
               daily: bool = True, run_id: str | None = None) -> dict[str, DataFrame]:
    """Append a batch of captures to the tables under ``root`` (``ingest_into``)
    in one commit: all tables have the batch, or, whatever fails, none.  A run
    that is repeated under its ``run_id`` replaces its quarantined rows.
    Returns the tables as read back."""
    tx = Transaction(spark, root)
    ingest_into(tx, snapshot, on_conflict, block_list, basket, daily, run_id)
    tx.commit()
    return stored_tables(spark, root)
