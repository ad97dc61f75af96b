"""Stored candle states (A3 as a rollup that ingest keeps up to date).

One row per (key, day) and six columns per indicator: the day's high and low,
its first and last non-null value and when they were seen.  States of parts of
a day merge into the state of the whole (highest, lowest, earliest, latest), so
a batch of captures only touches the days it has rows of, however often and in
whatever order they come.  Candle reports and divergence checks read these
rows instead of the captures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.operators.candles import CANDLE_FIELDS
from tapeflow.operators.windows import latest_per_key

INDICATORS = ("i_buy_pow", "i_buy_per_capita", "i_sell_per_capita")


def candle_states(flow: DataFrame, keys: Sequence[str] = ("ticker",), ts: str = "timestamp",
                  values: Sequence[str] = INDICATORS) -> DataFrame:
    """The states of the rows' (key, day)s; a day without any value of an
    indicator has NULLs for it."""
    day = F.col("date") if "date" in flow.columns else F.to_date(ts)
    aggs = []
    for v in values:
        at = F.when(F.col(v).isNotNull(), F.col(ts))
        aggs += [F.max(v).alias(f"{v}_high"), F.min(v).alias(f"{v}_low"),
                 F.min_by(v, at).alias(f"{v}_open"), F.max_by(v, at).alias(f"{v}_close"),
                 F.min(at).alias(f"{v}_open_at"), F.max(at).alias(f"{v}_close_at")]
    return flow.groupBy(*keys, day.alias("date")).agg(*aggs)


def merge_states(parts: DataFrame, keys: Sequence[str] = ("ticker",),
                 values: Sequence[str] = INDICATORS) -> DataFrame:
    """One state per (key, day) from states of any split of its captures."""
    aggs = []
    for v in values:
        aggs += [F.max(f"{v}_high").alias(f"{v}_high"), F.min(f"{v}_low").alias(f"{v}_low"),
                 F.min_by(f"{v}_open", f"{v}_open_at").alias(f"{v}_open"),
                 F.max_by(f"{v}_close", f"{v}_close_at").alias(f"{v}_close"),
                 F.min(f"{v}_open_at").alias(f"{v}_open_at"),
                 F.max(f"{v}_close_at").alias(f"{v}_close_at")]
    return parts.groupBy(*keys, "date").agg(*aggs)


def _latest(rollup: DataFrame, keys: Sequence[str], latest: int | None) -> DataFrame:
    return rollup if latest is None else latest_per_key(rollup, list(keys), "date", latest)


def rollup_candles(rollup: DataFrame, value: str, keys: Sequence[str] = ("ticker",),
                   latest: int | None = None) -> DataFrame:
    """``candles.indicator_candles`` from the rollup."""
    c = _latest(rollup, keys, latest).select(
        *keys, "date", *(F.col(f"{value}_{f}").alias(f) for f in CANDLE_FIELDS))
    return c.filter(F.col("open").isNotNull())


def rollup_stacked(rollup: DataFrame, values: Sequence[str], keys: Sequence[str] = ("ticker",),
                   latest: int | None = None) -> DataFrame:
    """``candles.stacked_candles`` from the rollup."""
    per = F.array(*(F.struct(F.lit(v).alias("indicator"),
                             *(F.col(f"{v}_{f}").cast("double").alias(f) for f in CANDLE_FIELDS))
                    for v in values))
    long = _latest(rollup, keys, latest).select(*keys, "date", F.inline(per))
    return long.filter(F.col("open").isNotNull()).select(
        *keys, "indicator", "date", *CANDLE_FIELDS)


def rollup_flow_candles(rollup: DataFrame, latest: int | None = None) -> DataFrame:
    """``screens.flow_candles`` (buy ``b_…``, sell ``s_…``) from the rollup."""
    return _latest(rollup, ("ticker",), latest).select(
        "ticker", "date",
        *(F.col(f"i_buy_per_capita_{f}").alias(f"b_{f}") for f in CANDLE_FIELDS),
        *(F.col(f"i_sell_per_capita_{f}").alias(f"s_{f}") for f in CANDLE_FIELDS))
