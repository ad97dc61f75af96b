"""Command line: the reference's scripts as Spark jobs over stored tables.

  python -m tapeflow ingest  --captures PATH --root ROOT [--format csv] [--index-name symbol]
                             [--on-conflict error|skip|replace] [--no-daily]
      daily + intraday + market-series load (I1–I3)
  python -m tapeflow follow  --captures PATH --root ROOT [--format csv] [--index-name symbol]
                             [--on-conflict skip|replace|error] [--max-files N] [--no-daily]
      the same load for the captures that have landed since the last run, each file once
  python -m tapeflow compact --root ROOT [--most N]
      merge the folders of partitions that many runs have added to
  python -m tapeflow screen  NAME|all --captures PATH --root ROOT --out PATH [--show N]
      one of the seven screens (Q1–Q7), or all in one pass, on the latest capture per ticker
  python -m tapeflow report stock      --root ROOT --out DIR [--tickers A,B]   (R1–R5, R9)
  python -m tapeflow report market     --root ROOT --out DIR                   (R6, R7)
  python -m tapeflow report candidates --captures PATH --root ROOT --out DIR   (Q7 → R8, R2, M16)

Results are written as parquet under --out; ``--show`` prints at most N
screen survivors (the reference printed its survivor list).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from tapeflow.functions.calendar import with_jalali_fields
from tapeflow.operators.joins import ticker_frame
from tapeflow.operators.screens import run_screens, screen
from tapeflow.operators.windows import latest_per_key
from tapeflow.plans import jobs, reports
from tapeflow.plans.screens import CANDLE_CANDIDATES, SPECS
from tapeflow.session import get_spark, staged
from tapeflow.sources.snapshots import latest_capture, quarantine, read_snapshots
from tapeflow.sources.versions import compact, vacuum, version
from tapeflow.streaming.follow import follow, landed_schema


def _captures(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    opts = {"header": "true"} if a.format == "csv" else {}
    return read_snapshots(spark, a.captures, fmt=a.format, index_name=a.index_name, **opts)


def _current(spark: SparkSession, a) -> DataFrame:
    """The snapshot a screen sees: the newest capture, as the reference's
    replaced table; with ``--all-captures`` the latest row of every ticker
    ever landed."""
    snap = quarantine(_captures(spark, a))[0]
    return latest_per_key(snap if a.all_captures else latest_capture(snap), ["ticker"], "download", 1)


def _write(frames: dict[str, DataFrame], out: str) -> None:
    """Write report frames; dated frames get Jalali labels for the chart axis."""
    for name, df in frames.items():
        if "date" in df.columns and "j_year" not in df.columns:
            df = with_jalali_fields(df, "date")
        df.write.mode("overwrite").parquet(os.path.join(out, name))
        print(f"wrote {name} → {os.path.join(out, name)}")


def cmd_ingest(spark, a):
    tables = jobs.run_ingest(spark, _captures(spark, a), a.root, a.on_conflict, daily=not a.no_daily)
    for name, df in tables.items():
        print(f"{name}: {os.path.join(a.root, name)}")


def cmd_follow(spark, a):
    opts = {"header": "true"} if a.format == "csv" else {}
    schema = landed_schema(spark, a.captures, a.format, **opts)
    follow(spark, a.captures, a.root, a.checkpoint or f"{a.root}/_follow", schema, a.format,
           a.index_name, a.on_conflict, daily=not a.no_daily, max_files=a.max_files, **opts)
    at = version(spark, a.root)
    print(f"{a.root} is at version {at.number}: {', '.join(sorted(at.tables))}")


def cmd_compact(spark, a):
    for name, (partition_by, keys) in jobs.LAYOUT.items():
        n = compact(spark, a.root, name, partition_by, keys, a.most)
        print(f"{name}: {n} partitions rewritten")
    print(f"{vacuum(spark, a.root)} old folders deleted")


def cmd_screen(spark, a):
    current = _current(spark, a)
    t = jobs.stored_tables(spark, a.root)
    if a.name == "all":
        result = run_screens(current, SPECS.values(), daily=t.get("daily"),
                             rollup=t.get("rollup"))
    else:
        result = screen(current, SPECS[a.name], daily=t.get("daily"), rollup=t.get("rollup"))
    result.write.mode("overwrite").parquet(a.out)
    print(f"wrote {a.name} → {a.out}")
    if a.show:
        for r in result.limit(a.show).collect():
            print(r.ticker, round(r.buy_power, 3))


def cmd_report(spark, a):
    t = jobs.stored_tables(spark, a.root)
    watch = ticker_frame(spark, a.tickers.split(",")) if a.tickers else None
    if a.kind == "stock":
        frames = {
            "buy_power_candles": reports.stock_buy_power_candles(None, t["daily"], watch,
                                                                 rollup=t["rollup"]),
            "price_candles": reports.stock_price_candles(t["daily"], watch),
            "per_capita_candles": reports.stock_per_capita_candles(None, t["daily"], watch,
                                                                   rollup=t["rollup"]),
            "last_session": reports.stock_last_session(t["intraday"], watch, t.get("sessions")),
            "valuation": reports.stock_valuation(t["daily"], watch, display=True),
            "buy_power_gaps": reports.candle_calendar_gaps(reports.stock_buy_power_candles(
                None, t["daily"], watch, rollup=t["rollup"])),
            "calendar_gaps": reports.price_calendar_gaps(
                reports.stock_price_candles(t["daily"], watch)),
        }
    elif a.kind == "market":
        candles = reports.market_candles(None, t["index_rollup"])
        frames = {"candles": candles,
                  "calendar_gaps": reports.candle_calendar_gaps(candles, ("universe",)),
                  "last_session": reports.market_last_session(t["index"])}
    else:
        current = _current(spark, a)
        survivors = staged(screen(current, CANDLE_CANDIDATES, daily=t["daily"], ordered=False),
                           "survivors")
        picked = survivors.select("ticker")
        frames = {"buy_power_candles": reports.screened_candles(survivors, None, t["daily"],
                                                               rollup=t["rollup"]),
                  "price_candles": reports.price_candle_geometry(t["daily"], picked)}
    _write(frames, a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tapeflow", description=__doc__.split("\n")[0])
    p.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    sub = p.add_subparsers(dest="command", required=True)

    def captures(sp, required=True):
        sp.add_argument("--captures", required=required, help="landed snapshot files")
        sp.add_argument("--format", default="parquet", choices=["parquet", "csv", "json", "orc"])
        sp.add_argument("--index-name", default=None, help="raw column holding the symbol")

    i = sub.add_parser("ingest")
    captures(i)
    i.add_argument("--root", required=True)
    i.add_argument("--on-conflict", default="error", choices=["error", "skip", "replace"])
    i.add_argument("--no-daily", action="store_true", help="intraday and market series only")
    i.set_defaults(run=cmd_ingest)

    f = sub.add_parser("follow")
    captures(f)
    f.add_argument("--root", required=True)
    f.add_argument("--checkpoint", default=None, help="default: _follow under the root")
    f.add_argument("--on-conflict", default="skip", choices=["error", "skip", "replace"])
    f.add_argument("--max-files", type=int, default=None, help="files of one commit, at most")
    f.add_argument("--no-daily", action="store_true", help="intraday and market series only")
    f.set_defaults(run=cmd_follow)

    k = sub.add_parser("compact")
    k.add_argument("--root", required=True)
    k.add_argument("--most", type=int, default=8, help="folders a partition may live in")
    k.set_defaults(run=cmd_compact)

    s = sub.add_parser("screen")
    s.add_argument("name", choices=sorted(SPECS) + ["all"],
                   help="one screen, or all seven in one pass")
    captures(s)
    s.add_argument("--root", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--show", type=int, default=0)
    s.add_argument("--all-captures", action="store_true",
                   help="screen the latest row of every ticker ever landed, not the newest capture")
    s.set_defaults(run=cmd_screen)

    r = sub.add_parser("report")
    r.add_argument("kind", choices=["stock", "market", "candidates"])
    captures(r, required=False)
    r.add_argument("--root", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--all-captures", action="store_true",
                   help="candidates from the latest row of every ticker ever landed")
    r.add_argument("--tickers", default=None, help="comma-separated watchlist (stock report)")
    r.set_defaults(run=cmd_report)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "report" and a.kind == "candidates" and not a.captures:
        print("report candidates needs --captures", file=sys.stderr)
        return 2
    spark = get_spark(a.master)
    a.run(spark, a)
    return 0
