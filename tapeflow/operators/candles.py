"""Daily candles of an indicator and their companions.

A candle of indicator ``v`` for a (key, day): high/low = max/min over the
day; open/close = first/last *non-null* value by capture time.  One
aggregation computes every indicator at once (``min_by``/``max_by``
ordered by a timestamp that is NULL where the value is NULL), replacing
three scans and two joins per indicator.  The aggregation is partial +
final, so a ticker with many captures a day is pre-reduced map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions.calendar import with_jalali_fields
from tapeflow.functions.columns import as_col
from tapeflow.operators.windows import latest_per_key

CANDLE_FIELDS = ("high", "low", "open", "close")


def _session(flow: DataFrame, ts: str) -> Column:
    """The session date of a row: the stored ``date`` partition column when
    the table has one (so joins on it can prune partitions), else the date
    of the capture time."""
    return F.col("date") if "date" in flow.columns else F.to_date(ts)


def latest_days(flow: DataFrame, n: int, keys: Sequence[str] = ("ticker",),
                ts: str = "timestamp", index: DataFrame | None = None) -> DataFrame:
    """Rows of each key's latest ``n`` session dates (dates counted over all
    rows, also days whose values are all NULL).

    The dates are picked first from the small distinct (key, date) set: the
    stored session table ``index`` (A6), or, without one, ``flow``'s own
    (partial aggregation, then a ``WindowGroupLimit`` top-n).  The rows are
    then semi-joined on (key…, date).  An aggregation after it touches only
    those days, and on a table partitioned by ``date`` the join can prune
    the other partitions at run time.
    """
    dated = flow.withColumn("_day", _session(flow, ts))
    days = dated.select(*keys, "_day").distinct() if index is None \
        else index.select(*keys, F.col("date").alias("_day"))
    keep = latest_per_key(days, list(keys), "_day", n)
    return dated.join(keep, [*keys, "_day"], "left_semi").drop("_day")


def candle_aggs(value: Column, ts: Column, prefix: str) -> list[Column]:
    ts_nn = F.when(value.isNotNull(), ts)
    return [F.max(value).alias(f"{prefix}high"), F.min(value).alias(f"{prefix}low"),
            F.min_by(value, ts_nn).alias(f"{prefix}open"),
            F.max_by(value, ts_nn).alias(f"{prefix}close")]


def candles_multi(flow: DataFrame, values: Mapping[str, str | Column],
                  keys: Sequence[str] = ("ticker",), ts: str = "timestamp") -> DataFrame:
    """A3 for several indicators in one pass; columns ``<name>_high`` … per
    indicator.  Days with no non-null value keep NULL open/close here."""
    t = F.col(ts)
    aggs = [a for name, v in values.items() for a in candle_aggs(as_col(v), t, f"{name}_")]
    return flow.groupBy(*keys, _session(flow, ts).alias("date")).agg(*aggs)


def indicator_candles(flow: DataFrame, value: str, keys: Sequence[str] = ("ticker",),
                      ts: str = "timestamp", latest: int | None = None,
                      index: DataFrame | None = None) -> DataFrame:
    """A3 (+W3): daily candles of one indicator; days without any non-null
    value are dropped.  ``latest`` keeps the latest n dates per key counted
    over *all* days (a day with only NULLs uses up a slot), as the
    reference's three separately limited sets intersect to."""
    if latest is not None:
        flow = latest_days(flow, latest, keys, ts, index)
    t = F.col(ts)
    c = flow.groupBy(*keys, _session(flow, ts).alias("date")).agg(
        *candle_aggs(F.col(value), t, ""))
    return c.filter(F.col("open").isNotNull())


def stacked_candles(flow: DataFrame, values: Sequence[str], keys: Sequence[str] = ("ticker",),
                    ts: str = "timestamp", latest: int | None = None,
                    index: DataFrame | None = None) -> DataFrame:
    """Candles of several indicators from one aggregation, in long form:
    ``(key…, indicator, date, high, low, open, close)``, values as double
    (indicators of different types share the columns)."""
    if latest is not None:
        flow = latest_days(flow, latest, keys, ts, index)
    wide = candles_multi(flow, {v: v for v in values}, keys, ts)
    per = F.array(*[F.struct(F.lit(v).alias("indicator"),
                             *[F.col(f"{v}_{f}").cast("double").alias(f) for f in CANDLE_FIELDS])
                    for v in values])
    long = wide.select(*keys, "date", F.inline(per))
    return long.filter(F.col("open").isNotNull()).select(
        *keys, "indicator", "date", *CANDLE_FIELDS)


def with_daily(candles: DataFrame, daily: DataFrame, cols: Sequence[str],
               keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Attach daily columns (inner equi-join on key and date)."""
    return candles.join(daily.select(*keys, "date", *cols), [*keys, "date"], "inner")


def candle_geometry(candles: DataFrame, open_: str = "open", high: str = "high",
                    low: str = "low", close: str = "close") -> DataFrame:
    """Bar geometry of a candle chart (bottom, height) per part.

    Up candle (close ≥ open): body from open, upper wick from close, lower
    wick from open.  Down candle: body from open, upper wick from open,
    lower wick from close.  Heights may be negative.
    """
    o, h, l, c = (F.col(x) for x in (open_, high, low, close))
    up = c >= o
    return candles.select(
        "*", up.alias("up"),
        o.alias("body_bottom"), (c - o).alias("body_height"),
        F.when(up, c).otherwise(o).alias("upper_bottom"),
        F.when(up, h - c).otherwise(h - o).alias("upper_height"),
        F.when(up, o).otherwise(c).alias("lower_bottom"),
        F.when(up, l - o).otherwise(l - c).alias("lower_height"))


def with_jalali(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add ``j_year, j_month, j_day`` for Jalali axis labels."""
    return with_jalali_fields(df, date_col)


def calendar_gap_runs(candles: DataFrame, keys: Sequence[str] = ("ticker",),
                      date_col: str = "date") -> DataFrame:
    """C4 as intervals: the runs (``gap_from``, ``gap_to``) of days between one
    candle of a key and its next.  One window over each key's session dates,
    which the calendar bounds."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    after = candles.select(*keys, date_col).withColumn("_next", F.lead(date_col).over(w))
    return after.filter(F.datediff("_next", date_col) > 1).select(
        *keys, F.date_add(date_col, 1).alias("gap_from"), F.date_sub("_next", 1).alias("gap_to"))


def calendar_gaps(candles: DataFrame, keys: Sequence[str] = ("ticker",),
                  date_col: str = "date") -> DataFrame:
    """C4: days between each key's first and last candle that have none,
    with their Jalali fields; only the gaps are expanded to days."""
    runs = calendar_gap_runs(candles, keys, date_col)
    days = runs.select(*keys, F.explode(F.sequence("gap_from", "gap_to")).alias(date_col))
    return with_jalali(days, date_col)
