"""Joins against key lists (ticker lists, screen survivors).

No list is hinted for broadcast.  A list given as Python values becomes a
literal relation on the JVM side, so the planner knows its size in bytes; one
derived from data is judged by the planner's estimate, and AQE still switches
to a broadcast at run time when its measured shuffle output is small.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticker_frame(spark: SparkSession, tickers: Iterable[str]) -> DataFrame:
    """A one-column ``ticker`` table from Python values, folded into the plan
    as a literal relation."""
    values = list(dict.fromkeys(tickers))
    array = F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    return spark.range(1).select(F.explode(array).alias("ticker"))


def keep_keys(df: DataFrame, keys_df: DataFrame, on: Sequence[str] | str = "ticker") -> DataFrame:
    """Rows whose key is in ``keys_df`` (semi-join)."""
    return df.join(keys_df.select(*_as_list(on)), on, "left_semi")


def drop_keys(df: DataFrame, keys_df: DataFrame, on: Sequence[str] | str = "ticker") -> DataFrame:
    """Rows whose key is not in ``keys_df`` (anti-join, NULL-safe on the
    stored side: a NULL key is never "in" the list)."""
    return df.join(keys_df.select(*_as_list(on)), on, "left_anti")


def _as_list(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)
