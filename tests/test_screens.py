import dataclasses

from pyspark.sql import functions as F

from tapeflow.operators.screens import (
    ScreenSpec, divergence_history, latest_divergence, persistence, screen)
from tapeflow.plans import catalog as CAT
from tapeflow.plans.screens import SPECS
from tapeflow.sources import fixtures as FX
from tests.conftest import SF_SMALL, rows

# FIXTURES §5, sf0.001 column.
EXPECTED_SF0001 = {"volatile_limit_up": 1, "smart_money_short": 4, "smart_money_off_limit": 1,
                   "smart_money_at_limit": 0, "divergence_at_limit": 0,
                   "divergence_off_limit": 1, "candle_candidates": 1}


def run(spark, name, d=SF_SMALL):
    return CAT.QUERIES[name](spark, d)


def test_fixture_counts(spark):
    assert FX.snapshots(spark, SF_SMALL).count() == 1000
    assert run(spark, "daily_flow").count() == 397
    assert run(spark, "divergence_history").count() == 29
    assert latest_divergence(run(spark, "intraday_flow")).count() == 1
    p = run(spark, "persistence")
    assert p.filter("hits >= 3").count() == 6
    assert run(spark, "persistence_unlocked").filter("hits > 3").count() == 2
    for name, n in EXPECTED_SF0001.items():
        assert run(spark, name).count() == n, name


def test_first_stage_counts(spark):
    snap = FX.current_snapshot(spark, SF_SMALL)
    for name, n in (("smart_money_off_limit", 2), ("divergence_at_limit", 1),
                    ("divergence_off_limit", 4), ("candle_candidates", 3)):
        spec = dataclasses.replace(SPECS[name], confirm=None)
        assert screen(snap, spec).count() == n, name


def test_tightening_never_adds(spark):
    snap = FX.current_snapshot(spark, "/root/testdata/sf0.01")
    base = SPECS["smart_money_short"]
    loose = {r.ticker for r in screen(snap, base).collect()}
    tight = {r.ticker for r in screen(snap, dataclasses.replace(base, min_pow=2.0, min_buy=20))
             .collect()}
    assert tight <= loose


def test_divergence_split_by_limit_state(spark):
    d = "/root/testdata/sf0.01"
    snap = FX.current_snapshot(spark, d)
    intraday = CAT.QUERIES["intraday_flow"](spark, d)
    at = {r.ticker for r in screen(snap, SPECS["divergence_at_limit"], intraday=intraday).collect()}
    off = {r.ticker for r in screen(snap, SPECS["divergence_off_limit"], intraday=intraday).collect()}
    any_state = dataclasses.replace(SPECS["divergence_at_limit"], at_limit=None)
    both = {r.ticker for r in screen(snap.filter("close IS NOT NULL AND day_ul IS NOT NULL"),
                                     any_state, intraday=intraday).collect()}
    assert at | off == both and not at & off and both


def test_order_and_tie_break(spark):
    snap = spark.createDataFrame(
        [(t, "عادی", "main", "10:00:00", None, 100.0, 120.0, 90.0, 105.0, 104.0, 110.0, 90.0,
          5.0, 4.0, 10, vb, 1e6, 0.0, 0.0, 1.0, 1.0, 1)
         for t, vb in (("B", 4e6), ("A", 4e6), ("C", 3e6))],
        "ticker string, trade_type string, market string, time string, "
        "download timestamp_ntz, open double, high double, low double, close double, "
        "final double, day_ul double, day_ll double, close_percent float, "
        "final_percent float, volume bigint, vol_buy_r double, vol_sell_r double, "
        "vol_buy_i double, vol_sell_i double, no_buy_r double, no_sell_r double, eps int")
    spec = ScreenSpec("t", 1.5, 25, 5, at_limit=False)
    assert [r.ticker for r in screen(snap, spec).collect()] == ["C", "A", "B"]


def test_persistence_counts_only_latest_five(spark):
    import datetime as dt
    good = (1.5, 20, 10, 5, 10)
    bad = (0.5, 20, 10, 5, 10)
    data = [("A", dt.date(2024, 1, i), *(bad if i <= 3 else good)) for i in range(1, 9)]
    data += [("S", dt.date(2024, 1, i), *good) for i in range(1, 3)]     # < 5 sessions
    df = spark.createDataFrame(data, "ticker string, date date, i_buy_pow float, "
                                     "i_buy_per_capita int, i_sell_per_capita int, "
                                     "low int, up_level int")
    got = {r["ticker"]: r["hits"] for r in rows(persistence(df, 5))}
    assert got == {"A": 5, "S": 2}
    assert {r["ticker"]: r["hits"] for r in rows(persistence(df, 5, unlocked=True))} == \
        {"A": 5, "S": 2}


def test_spec_and_input_validation(spark):
    import pytest
    with pytest.raises(ValueError):
        ScreenSpec("bad", 1, 1, 1, locked_by="close")
    with pytest.raises(ValueError):
        screen(FX.current_snapshot(spark, SF_SMALL), SPECS["smart_money_at_limit"])


def test_run_screens_equals_separate_screens(spark):
    from tapeflow.operators.screens import run_screens
    d = "/root/testdata/sf0.01"
    snap, daily, intraday = (FX.current_snapshot(spark, d), CAT.QUERIES["daily_flow"](spark, d),
                             CAT.QUERIES["intraday_flow"](spark, d))
    specs = list(SPECS.values()) + [dataclasses.replace(SPECS["smart_money_off_limit"],
                                                        name="q3_three_sessions", sessions=3)]
    together = run_screens(snap, specs, daily=daily, intraday=intraday)
    got = {}
    for r in together.collect():
        got.setdefault(r.screen, []).append(r.ticker)
    for spec in specs:
        alone = [r.ticker for r in screen(snap, spec, daily=daily, intraday=intraday).collect()]
        assert got.get(spec.name, []) == alone, spec.name
