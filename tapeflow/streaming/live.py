"""T4 with live evidence: screens that follow a ticker's history as it comes.

A screen's verdict hangs on the ticker's latest capture and on its evidence:
the latest sessions' persistence (A4, A5) and the latest session's divergence
(D1).  Captures bring both, and one that lands late changes the evidence and
not the latest capture.  Each micro-batch is one commit of three tables:

* ``live_days``      a state for each (ticker, day): candle states and the
                     day's last capture; only the batch's days are read
* ``live_standing``  a row for each ticker: its latest capture, the evidence of
                     its latest sessions, the screens it passes; by ``bucket``
* ``live_alerts``    a row for each screen a ticker entered or left

Days merge into days, latest sessions into latest sessions, so a batch costs
what it touches, however long the history is.  A ticker is judged again only if
its capture or its evidence changed; the verdict is one expression over its
row.  A repeated micro-batch, and a capture that lands twice, change nothing
and alert nobody.  Captures without a ticker or a time are left out (they are
the ingest's quarantine).  Of rows with the same ticker and time the one with
the smaller hash counts, as in the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeflow.functions.metrics import clean_ticker
from tapeflow.operators.candles import CANDLE_FIELDS
from tapeflow.operators.flows import daily_rows, to_intraday_flow
from tapeflow.operators.rollup import candle_states, merge_states
from tapeflow.operators.screens import (
    ScreenSpec, divergence_predicate, flow_columns, persistence_predicate, ranked, stage_predicate)
from tapeflow.operators.windows import latest_per_key
from tapeflow.session import staged
from tapeflow.sources.versions import Transaction, read_table
from tapeflow.streaming.streams import Sink

DAYS, STANDING, ALERTS = "live_days", "live_standing", "live_alerts"
VALUES = ("i_buy_per_capita", "i_sell_per_capita")
SESSION_FIELDS = ("i_buy_pow", "i_buy_per_capita", "i_sell_per_capita", "low", "up_level")
BUCKETS = 16


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key with ``_order``: what makes it the last one of
    any larger set of rows, too."""
    tie = F.xxhash64(*(F.col(c) for c in rows.columns))
    return latest_per_key(rows, keys, "download", 1) \
        .withColumn("_order", F.struct(F.col("download").alias("at"),
                                       F.bitwise_not(tie).alias("tie")))


def day_states(captures: DataFrame) -> DataFrame:
    """The state of each (ticker, day) of the captures (with ``date``)."""
    candles = candle_states(to_intraday_flow(captures), values=VALUES)
    last = _newest(captures, ["ticker", "date"])
    fields = daily_rows(last.drop("date")).select("ticker", "date", *SESSION_FIELDS)
    order = last.select("ticker", "date", "_order")
    return candles.join(fields.join(order, ["ticker", "date"]).select(
        "ticker", "date", F.struct("_order", *SESSION_FIELDS).alias("last")), ["ticker", "date"])


def merge_days(parts: DataFrame) -> DataFrame:
    """One state for each (ticker, day) from states of any split of its
    captures."""
    last = parts.groupBy("ticker", "date").agg(F.max("last").alias("last"))
    return merge_states(parts.drop("last"), values=VALUES).join(last, ["ticker", "date"])


def day_evidence(days: DataFrame) -> DataFrame:
    """ticker, date and what the screens ask of a session."""
    candles = [F.col(f"i_{side}_per_capita_{f}").alias(f"{side[0]}_{f}")
               for side in ("buy", "sell") for f in CANDLE_FIELDS]
    flags = {"hit": persistence_predicate(), "hit_unlocked": persistence_predicate(True),
             "diverges": divergence_predicate()}
    return days.select("ticker", "date", *(F.col(f"last.{f}").alias(f) for f in SESSION_FIELDS),
                       *candles) \
        .select("ticker", "date", *(F.coalesce(p, F.lit(False)).alias(n) for n, p in flags.items()))


def _newest_sessions(old: str, new: str, n: int) -> Column:
    """The ``n`` latest sessions of two lists; ``new`` wins on a common day."""
    fresh = F.coalesce(F.col(new), F.array())
    kept = F.filter(F.coalesce(F.col(old), F.array()), lambda o: ~F.exists(
        fresh, lambda x: x["date"] == o["date"]))
    return F.slice(F.reverse(F.array_sort(F.concat(kept, fresh))), 1, n)


def _only_in(one: str, other: str) -> Column:
    """The screens of one list that the other does not have."""
    rest = F.coalesce(F.col(other), F.array())
    return F.filter(F.coalesce(F.col(one), F.array()), lambda x: ~F.exists(
        rest, lambda y: y["screen"] == x["screen"]))


def _hits(spec: ScreenSpec) -> Column:
    flag = "hit_unlocked" if spec.unlocked_history else "hit"
    return F.size(F.filter(F.slice("recent", 1, spec.sessions), lambda x: x[flag])).cast("long")


def passing(specs: Iterable[ScreenSpec]) -> Column:
    """The screens a row (its latest capture's columns and ``recent``) passes,
    with their figures."""
    out = []
    for s in specs:
        hits, ok = F.lit(None).cast("long"), F.lit(True)
        if s.confirm == "persistence":
            hits = _hits(s)
            ok = hits > s.min_hits if s.strict_hits else hits >= s.min_hits
        elif s.confirm == "divergence":
            ok = F.coalesce(F.get("recent", F.lit(0))["diverges"], F.lit(False))
        out.append(F.when(stage_predicate(s) & ok, F.struct(
            F.lit(s.name).alias("screen"), *flow_columns()[1:], hits.alias("hits"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _standing(tx: Transaction, captures: DataFrame, evidence: DataFrame,
              specs: list[ScreenSpec], epoch: int) -> DataFrame:
    """The rows of all tickers in the buckets that the batch touches, with
    ``_before``: the screens a row passed before the batch."""
    n = max([s.sessions for s in specs if s.confirm == "persistence"] + [1])
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(BUCKETS)).cast("int")
    recent = latest_per_key(evidence, ["ticker"], "date", n).groupBy("ticker").agg(
        F.collect_list(F.struct("date", "hit", "hit_unlocked", "diverges")).alias("_recent"))
    snapshot = captures.drop("date")
    now = _newest(snapshot, ["ticker"]).select(
        "ticker", F.struct("_order", *snapshot.columns).alias("_current"))
    new = staged(now.join(recent, "ticker").withColumn("bucket", bucket), "live-tickers")
    touched = [f"bucket={r.bucket}" for r in new.select("bucket").distinct().collect()]
    stored = tx.table(STANDING, None, touched)
    if stored is None:
        nothing = F.lit(None)
        both = new.withColumns({"current": nothing.cast(new.schema["_current"].dataType),
                                "recent": nothing.cast(new.schema["_recent"].dataType),
                                "passing": nothing, "judged": nothing.cast("long")})
    else:
        both = new.join(stored, ["ticker", "bucket"], "full")
    newer = F.col("current").isNull() | (F.col("_current._order") > F.col("current._order"))
    merged = both.select(
        "ticker", "bucket", F.col("passing").alias("_before"), "judged",
        F.col("current").alias("_old"), F.col("recent").alias("_old_recent"),
        F.when(newer & F.col("_current").isNotNull(), F.col("_current"))
        .otherwise(F.col("current")).alias("current"),
        _newest_sessions("recent", "_recent", n).alias("recent"))
    changed = ~(F.col("_old").eqNullSafe(F.col("current"))
                & F.col("_old_recent").eqNullSafe(F.col("recent")))
    flat = merged.select("*", changed.alias("_changed"), *(
        F.col(f"current.{c}").alias(c) for c in snapshot.columns if c != "ticker"))
    verdict = passing(specs)
    if stored is None:
        flat = flat.withColumn("_before", F.array().cast(flat.select(verdict).schema[0].dataType))
    return flat.select(
        "ticker", "bucket", "current", "recent",
        F.when(F.col("_changed"), verdict).otherwise(F.col("_before")).alias("passing"),
        F.when(F.col("_changed"), F.lit(epoch)).otherwise(F.col("judged")).cast("long")
        .alias("judged"),
        "_before")


def live_screen_sink(spark: SparkSession, root: str, specs: Iterable[ScreenSpec]) -> Sink:
    """T4 for any screens at once: the captures of a micro-batch are both what
    is judged and its evidence.  The screens of a root stay the same."""
    specs = list(specs)

    def sink(batch: DataFrame, epoch: int) -> None:
        tx = Transaction(spark, root)
        known = tx.table(STANDING)
        if known is not None:  # the columns of the first batch, in their order
            fields = known.schema["current"].dataType.fieldNames()
            batch = batch.select(*(c for c in fields if c != "_order"))
        rows = staged(batch.withColumn("ticker", clean_ticker("ticker"))
                      .withColumn("date", F.to_date("download"))
                      .filter("ticker IS NOT NULL AND date IS NOT NULL"), "live-captures")
        if rows.isEmpty():
            return
        new = staged(day_states(rows), "live-states")
        days, mine = new, new.select("ticker", "date")
        dates = [f"date={r.date}" for r in new.select("date").distinct().collect()]
        stored = tx.table(DAYS, None, dates)
        if stored is not None:
            days = staged(merge_days(new.unionByName(stored.select(*new.columns))), "live-days")
        evidence = day_evidence(days.join(mine, ["ticker", "date"], "left_semi"))
        standing = staged(_standing(tx, rows, evidence, specs, epoch), "live-standing")
        alerts = []
        for event, one, other in (("entered", "passing", "_before"), ("left", "_before", "passing")):
            alerts.append(standing.select("ticker", F.col("current.download").alias("download"),
                                          F.lit(event).alias("event"),
                                          F.inline(_only_in(one, other))))
        tx.write(DAYS, days, ["date"], ["ticker"], replace=True)
        tx.write(STANDING, standing.drop("_before"), ["bucket"], ["ticker"], replace=True)
        tx.write(ALERTS, alerts[0].unionByName(alerts[1]).withColumn(
            "epoch", F.lit(epoch).cast("long")))
        tx.commit()
    return sink


def live_screens(spark: SparkSession, root: str) -> DataFrame:
    """What passes now: ``operators.screens.run_screens`` over all captures
    read so far."""
    standing = read_table(spark, root, STANDING)
    return ranked(standing.select("ticker", F.inline("passing")).select(
        "screen", "ticker", "buy_power", "buy_per_capita", "sell_per_capita", "hits"), "screen")
