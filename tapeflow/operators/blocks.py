"""W2 over a stored daily table by prefix sums over month blocks.

A block is one ticker's sessions of one Jalali month.  The stored totals of all
blocks (sessions, volumes that are not NULL, summed volume) give each block the
number and volume of the sessions before it; running sums inside a block do the
rest.  So the volume of the ``n`` sessions before a row is the difference of two
prefix sums: at the row, and at the row ``n`` places before.  A batch reads
stored rows of the blocks it adds to and of those ``n`` places before its rows,
never the history between or before them, and changes the totals of the blocks
it adds to alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.columns import idiv
from tapeflow.session import staged

MONTH = ["j_year", "j_month"]
BLOCK = ["ticker", *MONTH]
KEYS = ["ticker", "date"]
TOTALS = ("sessions", "volumes", "volume")


def block_totals(daily: DataFrame, volume: str = "volume") -> DataFrame:
    """One row per block: its sessions, its volumes that are not NULL, their sum."""
    v = F.col(volume).cast("long")
    return daily.groupBy(*BLOCK).agg(
        F.count(F.lit(1)).alias("sessions"), F.count(v).alias("volumes"),
        F.coalesce(F.sum(v), F.lit(0)).cast("long").alias("volume"))


def months_of(rows: DataFrame) -> list[tuple[int, int]]:
    """The months of the rows: as many as partitions they belong to."""
    return sorted(tuple(r) for r in rows.select(*MONTH).distinct().collect())


def _starts(totals: DataFrame) -> DataFrame:
    """Each block's size, and the totals of its ticker's blocks before it."""
    before = Window.partitionBy("ticker").orderBy(*MONTH).rowsBetween(
        Window.unboundedPreceding, -1)
    return totals.select(*BLOCK, F.col("sessions").alias("_size"), *(
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in TOTALS))


def _placed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (whole blocks) with their place among their ticker's sessions and
    the number and sum of the volumes before them."""
    inside = Window.partitionBy(*BLOCK).orderBy("date").rowsBetween(
        Window.unboundedPreceding, -1)
    v = F.col("volume").cast("long")
    return rows.join(starts, BLOCK).select(
        *rows.columns,
        (F.col("_sessions") + F.count(F.lit(1)).over(inside)).alias("_at"),
        (F.col("_volumes") + F.count(v).over(inside)).alias("_n"),
        (F.col("_volume") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias("_sum"))


def appended_by_blocks(batch: DataFrame, read: Callable[[list[tuple[int, int]]], DataFrame],
                       totals: DataFrame, n: int = 42, refresh: bool = False,
                       out: str = "average_volume"
                       ) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """W2 for a batch of daily rows that is added to a stored table.

    ``batch`` has unique keys and the month columns; its rows stand for stored
    ones of the same key.  ``read(months)`` gives the stored rows of those
    months, ``totals`` the stored block totals.  A batch may span many days, or
    come out of order.  Returns the batch with its averages; with ``refresh``
    the keys of stored sessions whose trailing window now holds a batch row,
    with their new averages (else None); and the totals of all blocks of the
    batch's months as they are with the batch.
    """
    months, cols = months_of(batch), [*BLOCK, "date", "volume"]
    mine = batch.select(*cols, F.lit(1).alias("_new"))
    own = batch.select(*BLOCK).distinct()
    stored = (read(months).select(*cols).join(own, BLOCK, "left_semi")
              .join(batch.select(*KEYS), KEYS, "left_anti"))
    touched = staged(stored.withColumn("_new", F.lit(0)).unionByName(mine), "touched-blocks")
    now = staged(totals.select(*BLOCK, *TOTALS).join(own, BLOCK, "left_anti").unionByName(
        block_totals(touched)), "block-totals")
    starts = _starts(now)

    # Blocks with rows ``n`` places before the batch's; with ``refresh`` all
    # from there to ``n`` places after them.
    at = _placed(touched, starts).filter("_new = 1").groupBy(*BLOCK).agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    span = at.select("ticker", (F.col("_first") - n).alias("_from"),
                     (F.col("_last") + (n if refresh else -n)).alias("_to"))
    near = starts.join(span, "ticker").filter(
        (F.col("_sessions") <= F.col("_to"))
        & (F.col("_sessions") + F.col("_size") > F.col("_from")))
    near = staged(near.select(*BLOCK).distinct().join(own, BLOCK, "left_anti"), "near-blocks")
    rows = _placed(touched.unionByName(
        read(months_of(near)).select(*cols, F.lit(0).alias("_new")).join(
            near, BLOCK, "left_semi")), starts)

    marks = rows.select("ticker", (F.col("_at") + n).alias("_at"), F.col("_n").alias("_n0"),
                        F.col("_sum").alias("_sum0"))
    c = F.col("_n") - F.coalesce("_n0", F.lit(0))
    s = F.col("_sum") - F.coalesce("_sum0", F.lit(0))
    done = rows.join(marks, ["ticker", "_at"], "left") \
        .withColumn(out, F.when(c > 0, idiv(s * 2 + c, c * 2)))
    averages = done.filter("_new = 1").select(*KEYS, out)
    refreshed = None
    if refresh:
        before = Window.partitionBy("ticker").orderBy("_at").rangeBetween(-n, -1)
        refreshed = done.withColumn("_touched", F.max("_new").over(before)) \
            .filter("_new = 0 AND _touched = 1").select(*KEYS, out)
    return (batch.drop(out).join(averages, KEYS), refreshed,
            now.join(batch.select(*MONTH).distinct(), MONTH, "left_semi"))
