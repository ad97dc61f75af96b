import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tapeflow.operators.candles import indicator_candles
from tapeflow.operators.flows import daily_series, to_intraday_flow
from tapeflow.operators.screens import ranked, screen
from tapeflow.operators.windows import latest_per_key
from tapeflow.plans import jobs as J
from tapeflow.plans.catalog import QUERIES
from tapeflow.plans.oracle import ORACLE
from tapeflow.plans.screens import SPECS
from tapeflow.sources import fixtures as FX
from tapeflow.streaming import streams as ST
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, frame_hash


def _same(a, b):
    b = b.select(a.columns)
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_streams_stop_and_resume_in_any_order(spark, tmp_path):
    """Half of the files, then (a new query on the same paths) the others, one
    file for each micro-batch, captures in no order; with repeated rows."""
    snap = FX.snapshots(spark, SF_SMALL)
    again = snap.filter(F.hour("download") == 10)
    early = F.xxhash64("ticker") % 2 == 0
    folder = str(tmp_path / "landed")
    block, basket = FX.ticker_lists(spark, SF_SMALL)
    spec = SPECS["smart_money_off_limit"]
    daily = daily_series(snap)
    sinks = {
        "dedup": lambda out: ST.intraday_sink(spark, out),
        "live": lambda out: ST.candle_sink(spark, out, "i_buy_pow"),
        "log": lambda out: ST.candle_log_sink(out, "i_buy_pow"),
        "market": lambda out: ST.market_sink(spark, out, block, basket, FX.hourly_cross_sections),
        "screen": lambda out: ST.screen_sink(spark, out, spec, daily=daily),
    }
    for part in (snap.filter(early), snap.filter(~early)):
        part.repartition(2, F.xxhash64("download")).write.mode("append").parquet(folder)
        for name, sink in sinks.items():
            stream = ST.read_capture_stream(spark, folder, snap.schema, 1)
            ST.run_stream(stream, sink(f"{tmp_path}/{name}"), f"{tmp_path}/{name}-checkpoint")
    flow = to_intraday_flow(snap)
    candles = indicator_candles(flow, "i_buy_pow")
    assert _same(ST.stored_intraday(spark, f"{tmp_path}/dedup"), flow)
    assert _same(ST.stored_candles(spark, f"{tmp_path}/live"), candles)
    assert _same(ST.logged_candles(spark, f"{tmp_path}/log"), candles)
    assert _same(ST.stored_market(spark, f"{tmp_path}/market"),
                 J.market_load(FX.hourly_cross_sections(snap), block, basket))
    verdicts = ST.stored_verdicts(spark, f"{tmp_path}/screen")
    assert verdicts.count() == snap.select("ticker").distinct().count()
    current = latest_per_key(snap, ["ticker"], "download", 1)
    want = screen(current, spec, daily=daily)

    def passing():
        """The tickers that pass by their latest capture, ranked."""
        v = ST.stored_verdicts(spark, f"{tmp_path}/screen")
        return ranked(v.filter("passes").drop("passes", "download"))
    assert _same(passing(), want)
    # repeated captures, dealt to files in another way, change no table
    again.write.mode("append").parquet(folder)
    for name in sinks:
        stream = ST.read_capture_stream(spark, folder, snap.schema, 1)
        ST.run_stream(stream, sinks[name](f"{tmp_path}/{name}"), f"{tmp_path}/{name}-checkpoint")
    assert _same(ST.stored_intraday(spark, f"{tmp_path}/dedup"), flow)
    assert _same(ST.stored_candles(spark, f"{tmp_path}/live"), candles)
    assert _same(ST.logged_candles(spark, f"{tmp_path}/log"), candles)
    assert _same(ST.stored_market(spark, f"{tmp_path}/market"),
                 J.market_load(FX.hourly_cross_sections(snap), block, basket))
    assert _same(passing(), want)


def test_a_failing_stream_raises(spark, tmp_path):
    snap = FX.snapshots(spark, SF_SMALL)
    snap.limit(5).write.parquet(str(tmp_path / "in"))

    def broken(batch, epoch):
        raise RuntimeError("sink failed")
    with pytest.raises(Exception, match="sink failed"):
        ST.run_stream(ST.read_capture_stream(spark, str(tmp_path / "in"), snap.schema), broken,
                      str(tmp_path / "checkpoint"))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 29
    assert E.entry(spark).schema == df.schema          # stable schema across calls
    assert set(QUERIES) == set(ORACLE) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert len(got) == len(want)
    assert sorted(got.columns) == sorted(want.columns)
    assert frame_hash(got) == frame_hash(want)
