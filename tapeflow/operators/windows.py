"""Per-key top-n and trailing-window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import idiv


def latest_per_key(df: DataFrame, keys: Sequence[str], order_col: str, n: int = 1,
                   by_value: bool = False) -> DataFrame:
    """Rows with the ``n`` largest ``order_col`` per key.

    ``row_number`` (or ``dense_rank`` when ``by_value``: all rows of the
    latest ``n`` distinct values) filtered by a literal bound is planned as
    ``WindowGroupLimit``: a partial limit runs before the shuffle, so each
    map task ships at most ``n`` rows (``n`` values) per key — a hot key
    does not reach one reducer whole.  Rows with an equal ``order_col`` are
    chosen by a hash of the whole row, the same ones in every run.
    """
    ties = [] if by_value else [F.xxhash64(*(F.col(c) for c in df.columns))]
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc(), *ties)
    rank = F.dense_rank() if by_value else F.row_number()
    return (df.withColumn("_rn", rank.over(w))
              .filter(F.col("_rn") <= n)
              .drop("_rn"))


def latest_sessions(daily: DataFrame, n: int, keys: Sequence[str] = ("ticker",),
                    date_col: str = "date") -> DataFrame:
    """The latest ``n`` sessions (rows, one per date) per key."""
    return latest_per_key(daily, list(keys), date_col, n)


def with_average_volume(daily: DataFrame, n: int = 42, keys: Sequence[str] = ("ticker",),
                        volume: str = "volume", date_col: str = "date",
                        out: str = "average_volume") -> DataFrame:
    """Mean volume of the ``n`` sessions *before* each row (first NULL).

    The mean is exact: ``(2·sum + cnt) div (2·cnt)`` rounds half up on
    non-negative integer volumes, as a NUMERIC average stored into INT8.
    The partition is one ticker's daily rows; ``(ticker, date)`` is unique,
    so a partition never exceeds the number of sessions in the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(date_col).rowsBetween(-n, -1)
    s = F.sum(F.col(volume).cast("long")).over(w)
    c = F.count(volume).over(w)
    return daily.withColumn(out, F.when(c > 0, idiv(s * 2 + c, c * 2)))


def appended_average_volume(batch: DataFrame, history: DataFrame, n: int = 42,
                            volume: str = "volume", out: str = "average_volume"
                            ) -> tuple[DataFrame, DataFrame]:
    """W2 for a batch of daily rows that is added to a stored table.

    ``history`` holds no key of the batch.  Per ticker of the batch it gives
    the latest ``n`` sessions before the batch's first date and all later
    ones; the one-pass window then runs over them and the batch together, so
    a batch may span many days or come out of order.  Returns the batch with
    its averages, and the keys of stored sessions whose trailing window now
    holds a batch row, with their new averages.
    """
    first = batch.groupBy("ticker").agg(F.min("date").alias("_first"))
    near = history.select("ticker", "date", volume).join(first, "ticker")
    before = latest_per_key(near.filter(F.col("date") < F.col("_first")), ["ticker"], "date", n)
    stored = (before.unionByName(near.filter(F.col("date") >= F.col("_first")))
              .select("ticker", "date", volume, F.lit(0).alias("_new")))
    both = stored.unionByName(batch.select("ticker", "date", volume, F.lit(1).alias("_new")))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-n, -1)
    done = with_average_volume(both, n, volume=volume, out=out) \
        .withColumn("_touched", F.max("_new").over(w))
    averages = done.filter(F.col("_new") == 1).select("ticker", "date", out)
    refreshed = done.filter((F.col("_new") == 0) & (F.col("_touched") == 1)) \
        .select("ticker", "date", out)
    return batch.drop(out).join(averages, ["ticker", "date"]), refreshed


def last_session(flow: DataFrame, keys: Sequence[str] = ("ticker",),
                 ts: str = "timestamp", index: DataFrame | None = None) -> DataFrame:
    """Every row of each key's latest session date.

    The per-key latest date is an aggregate (partial + final) over ``index``,
    the stored (key, date) table (A6), or, without one, over the key and date
    columns of ``flow`` itself.  The rows are then matched on ``(key…, date)``,
    so the shuffle spreads a hot key over its dates instead of sending it to
    one task, and a table partitioned by date reads only those days.
    """
    day = F.col("date") if "date" in flow.columns else F.to_date(ts)
    dated = flow.withColumn("_d", day)
    days = dated if index is None else index.withColumn("_d", F.col("date"))
    latest = days.groupBy(*keys).agg(F.max("_d").alias("_d"))
    return dated.join(latest, [*keys, "_d"], "left_semi").drop("_d")


def sessions(flow: DataFrame, keys: Sequence[str] = ("ticker",), ts: str = "timestamp") -> DataFrame:
    """Distinct session dates per key (the stored ``date`` partition
    column where the table has one, so only that column is read)."""
    day = F.col("date") if "date" in flow.columns else F.to_date(ts)
    return flow.select(*keys, day.alias("date")).distinct()
