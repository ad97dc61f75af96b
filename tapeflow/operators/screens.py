"""Snapshot screens with history confirmation.

A screen is one logical plan: filter the current snapshot, join the
survivors with per-ticker history evidence on ``ticker``, sort.  History
is pre-filtered to the survivors with a semi-join, so only their rows are
shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.functions import metrics as M
from tapeflow.operators import universe as U
from tapeflow.operators.candles import candles_multi
from tapeflow.operators.rollup import rollup_flow_candles
from tapeflow.operators.windows import last_session, latest_sessions
from tapeflow.session import staged


@dataclass(frozen=True)
class ScreenSpec:
    """Thresholds and confirmation of one screen."""
    name: str
    min_pow: float
    min_buy: float
    min_sell: float
    max_sell: float | None = None
    locked_by: str = "low"          # F10: "low" or "open" must be < day_ul
    at_limit: bool | None = False   # F9: close = day_ul (True), != (False), no test (None)
    drop_base: bool = False         # F2: also drop the base market
    confirm: str | None = None      # None, "persistence" or "divergence"
    sessions: int = 5               # persistence window (latest n sessions)
    min_hits: int = 3               # persistence threshold
    strict_hits: bool = False       # hits > min_hits instead of ≥
    unlocked_history: bool = False  # A5: history rows also need low < up_level

    def __post_init__(self):
        if self.locked_by not in ("low", "open"):
            raise ValueError(f"locked_by must be 'low' or 'open', not {self.locked_by!r}")
        if self.confirm not in (None, "persistence", "divergence"):
            raise ValueError(f"unknown confirmation {self.confirm!r}")


def persistence_predicate(unlocked: bool = False) -> Column:
    pred = ((F.col("i_buy_pow") >= 1) & (F.col("i_buy_per_capita") > 15)
            & (F.col("i_sell_per_capita") > 5))
    if unlocked:
        pred = pred & (F.col("low") < F.col("up_level"))
    return pred


def persistence(daily: DataFrame, n: int = 5, unlocked: bool = False) -> DataFrame:
    """A4/A5: per ticker, how many of its latest ``n`` sessions show strong
    retail buying (stored, rounded values)."""
    last = latest_sessions(daily, n)
    return last.groupBy("ticker").agg(
        F.count(F.when(persistence_predicate(unlocked), F.col("date"))).alias("hits"))


def flow_candles(intraday: DataFrame) -> DataFrame:
    """Buy- and sell-per-capita candles per (ticker, date), one aggregation."""
    return candles_multi(intraday, {"b": "i_buy_per_capita", "s": "i_sell_per_capita"})


def divergence_predicate() -> Column:
    """D1 on integer candles, evaluated exactly: ``b.close > 1.3·b.open`` is
    ``10·b.close > 13·b.open`` (and likewise 1.2), no float rounding."""
    b = {f: F.col(f"b_{f}").cast("long") for f in ("high", "low", "open", "close")}
    s = {f: F.col(f"s_{f}").cast("long") for f in ("high", "low", "open", "close")}
    return ((b["close"] * 10 > b["open"] * 13)
            & (s["open"] * 10 > s["close"] * 12)
            & (b["close"] - b["open"] > (b["high"] - b["close"]) * 2)
            & (s["open"] - s["close"] > (s["close"] - s["low"]) * 2))


def divergence_history(intraday: DataFrame | None, rollup: DataFrame | None = None) -> DataFrame:
    """Every (ticker, day) whose buy/sell per-capita candles diverge (D1);
    from the stored candle states ``rollup`` if given."""
    candles = flow_candles(intraday) if rollup is None else rollup_flow_candles(rollup)
    return candles.filter(divergence_predicate())


def latest_divergence(intraday: DataFrame | None, sessions: DataFrame | None = None,
                      rollup: DataFrame | None = None) -> DataFrame:
    """D1 on each ticker's latest session (latest date over *all* its rows;
    a latest day without values fails).  Only the rows of that day are
    aggregated (J4 first, then the candles); with ``rollup`` none are."""
    if rollup is not None:
        return rollup_flow_candles(rollup, latest=1).filter(divergence_predicate())
    return flow_candles(last_session(intraday, index=sessions)).filter(divergence_predicate())


def stage_predicate(spec: ScreenSpec) -> Column:
    """The first-stage test of a screen (universe, flow thresholds, lock and
    limit state): TRUE only where the row passes.  Exclusions keep NULLs,
    thresholds drop them."""
    pred = (~F.coalesce(U.outside_universe(drop_base=spec.drop_base), F.lit(False))
            & U.strong_flow(spec.min_pow, spec.min_buy, spec.min_sell, spec.max_sell)
            & U.traded_below_limit(spec.locked_by))
    if spec.at_limit is not None:
        pred = pred & U.closes_at_limit(spec.at_limit)
    return F.coalesce(pred, F.lit(False))


def flow_columns() -> list[Column]:
    return [M.clean_ticker("ticker").alias("ticker"), M.buy_power().alias("buy_power"),
            M.buy_per_capita().alias("buy_per_capita"),
            M.sell_per_capita().alias("sell_per_capita")]


def snapshot_stage(snapshot: DataFrame, spec: ScreenSpec) -> DataFrame:
    """First stage: the rows that pass, with their flow metrics."""
    return snapshot.filter(stage_predicate(spec)).select(*flow_columns())


def ranked(survivors: DataFrame, *within: str) -> DataFrame:
    """O1: rank by buy power (then ticker), in that order.  Survivors are at
    most one row for each ticker (and screen)."""
    order = [F.col("buy_power").asc(), F.col("ticker").asc()]
    w = Window.partitionBy(*within).orderBy(*order)
    return survivors.withColumn("rank", F.row_number().over(w).cast("long")) \
        .orderBy(*within, *order)


def screen(snapshot: DataFrame, spec: ScreenSpec, daily: DataFrame | None = None,
           intraday: DataFrame | None = None, ordered: bool = True,
           sessions: DataFrame | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """Run one screen on the current snapshot (one row per ticker).

    A persistence screen needs the ``daily`` table, a divergence screen the
    stored candle states ``rollup`` or the ``intraday`` table (and, to read
    only each ticker's last day of it, the stored ``sessions``).  The first stage is staged: history is narrowed to
    its survivors and joined with them, and the snapshot is read once.
    """
    if spec.confirm == "persistence" and daily is None:
        raise ValueError(f"screen {spec.name} confirms on the daily table: pass daily=")
    if spec.confirm == "divergence" and intraday is None and rollup is None:
        raise ValueError(f"screen {spec.name} confirms on candles: pass intraday= or rollup=")
    first = snapshot_stage(snapshot, spec)
    if spec.confirm is not None:
        first = staged(first, "screen-stage")
    out = first
    if spec.confirm == "persistence":
        hist = daily.join(first.select("ticker"), "ticker", "left_semi")
        hits = persistence(hist, spec.sessions, spec.unlocked_history)
        out = first.join(hits, "ticker", "left").withColumn(
            "hits", F.coalesce("hits", F.lit(0).cast("long")))
        ok = F.col("hits") > spec.min_hits if spec.strict_hits else F.col("hits") >= spec.min_hits
        out = out.filter(ok)
    elif spec.confirm == "divergence":
        div = _divergence_of(first.select("ticker"), intraday, sessions, rollup)
        out = out.join(div.select("ticker"), "ticker", "left_semi")
    return ranked(out) if ordered else out


def _divergence_of(tickers: DataFrame, intraday: DataFrame | None, sessions: DataFrame | None,
                   rollup: DataFrame | None) -> DataFrame:
    """``latest_divergence`` of some tickers; only their history is read."""
    def mine(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(tickers, "ticker", "left_semi")
    return latest_divergence(mine(intraday), mine(sessions), mine(rollup))


def run_screens(snapshot: DataFrame, specs, daily: DataFrame | None = None,
                intraday: DataFrame | None = None, sessions: DataFrame | None = None,
                rollup: DataFrame | None = None) -> DataFrame:
    """Several screens in one pass over the current snapshot.

    Each row is tagged with the screens whose first stage it passes; the
    history evidence is computed once for all of them (both persistence
    counts in one aggregation, the latest-session divergence once) and
    joined on ``ticker``.  Output: ``screen, ticker, buy_power,
    buy_per_capita, sell_per_capita, hits`` (``hits`` for persistence
    screens, else NULL), ranked by buy power and ticker inside each screen.
    """
    specs = list(specs)
    if not specs:
        raise ValueError("run_screens needs at least one ScreenSpec")
    tags = F.filter(F.array(*[F.when(stage_predicate(s), F.lit(s.name)) for s in specs]),
                    lambda x: x.isNotNull())
    stage = snapshot.select(*flow_columns(), F.explode(tags).alias("screen"))
    stage = staged(stage, "screens-stage")
    out = stage
    persist = [s for s in specs if s.confirm == "persistence"]
    if persist:
        if daily is None:
            raise ValueError("persistence screens need daily=")
        hist = daily.join(stage.select("ticker").distinct(), "ticker", "left_semi")
        for n in sorted({s.sessions for s in persist}):
            last = latest_sessions(hist, n)
            counts = last.groupBy("ticker").agg(
                F.count(F.when(persistence_predicate(False), F.col("date"))).alias(f"_h4_{n}"),
                F.count(F.when(persistence_predicate(True), F.col("date"))).alias(f"_h5_{n}"))
            out = out.join(counts, "ticker", "left")
    if any(s.confirm == "divergence" for s in specs):
        if intraday is None and rollup is None:
            raise ValueError("divergence screens need intraday= or rollup=")
        div = _divergence_of(stage.select("ticker").distinct(), intraday, sessions, rollup) \
            .select("ticker", F.lit(True).alias("_div"))
        out = out.join(div, "ticker", "left")
    keep, hits = None, F.lit(None).cast("long")
    for s in specs:
        is_s = F.col("screen") == s.name
        if s.confirm == "persistence":
            h = F.coalesce(F.col(f"_h{5 if s.unlocked_history else 4}_{s.sessions}"), F.lit(0))
            ok = h > s.min_hits if s.strict_hits else h >= s.min_hits
            hits = F.when(is_s, h).otherwise(hits)
        elif s.confirm == "divergence":
            ok = F.coalesce(F.col("_div"), F.lit(False))
        else:
            ok = F.lit(True)
        term = is_s & ok
        keep = term if keep is None else keep | term
    return ranked(out.filter(keep).select("screen", "ticker", "buy_power", "buy_per_capita",
                                          "sell_per_capita", hits.alias("hits")), "screen")
