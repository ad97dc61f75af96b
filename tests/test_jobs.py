from pyspark.sql import functions as F

from tapeflow.operators.screens import screen
from tapeflow.operators.windows import latest_per_key
from tapeflow.plans import jobs as J
from tapeflow.plans import reports as R
from tapeflow.plans.explain import plan_text
from tapeflow.plans.screens import SPECS
from tapeflow.session import scratch_path
from tapeflow.sources import fixtures as FX
from tapeflow.sources.sinks import DuplicateKeyError
from tapeflow.sources.versions import Transaction, read_table, version
from tests.conftest import SF_SMALL

import pytest


def stored(spark, root, name):
    return read_table(spark, root, name)


def scans(df, path):
    """How many scans of a plan read files under ``path``."""
    return sum(path in line for line in plan_text(df).splitlines() if "FileScan" in line)


def test_incremental_ingest_equals_batch(spark):
    snap = FX.snapshots(spark, SF_SMALL)
    days = sorted(r.d for r in snap.select(F.to_date("download").alias("d")).distinct()
                  .orderBy("d").limit(6).collect())
    root = scratch_path(spark, "ingest")
    block, basket = FX.ticker_lists(spark, SF_SMALL)
    for d in days:
        J.run_ingest(spark, snap.filter(F.to_date("download") == F.lit(d)), root,
                     block_list=block, basket=basket)
    part = snap.filter(F.to_date("download") <= F.lit(days[-1]))
    batch = J.daily_load(part)
    daily = stored(spark, root, "daily").select(batch.columns)
    assert daily.count() == batch.count() > 0
    assert daily.exceptAll(batch).isEmpty() and batch.exceptAll(daily).isEmpty()
    intraday = stored(spark, root, "intraday").drop("date")
    assert intraday.exceptAll(J.intraday_load(part).select(intraday.columns)).isEmpty()
    assert intraday.count() == J.intraday_load(part).count()

    again = snap.filter(F.to_date("download") == F.lit(days[-1]))
    with pytest.raises(DuplicateKeyError):
        J.run_ingest(spark, again, root, block_list=block, basket=basket)
    J.run_ingest(spark, again, root, "skip", block_list=block, basket=basket)
    assert stored(spark, root, "daily").count() == batch.count()


def test_ingest_replace_rewrites_only_the_batch_keys(spark):
    snap = FX.snapshots(spark, SF_SMALL)
    days = sorted(r.d for r in snap.select(F.to_date("download").alias("d")).distinct()
                  .orderBy("d").limit(3).collect())
    root = scratch_path(spark, "ingest-replace")
    block, basket = FX.ticker_lists(spark, SF_SMALL)
    for d in days:
        J.run_ingest(spark, snap.filter(F.to_date("download") == F.lit(d)), root,
                     block_list=block, basket=basket)
    # an older version stays readable after a replace
    before = stored(spark, root, "intraday").drop("date")
    n_before = before.count()
    # re-ingest the middle day with doubled retail buy volume
    changed = snap.filter(F.to_date("download") == F.lit(days[1])) \
        .withColumn("vol_buy_r", F.col("vol_buy_r") * 2)
    J.run_ingest(spark, changed, root, "replace", block_list=block, basket=basket)
    after = stored(spark, root, "intraday").drop("date")
    assert after.count() == n_before
    mid = F.to_date("timestamp") == F.lit(days[1])
    untouched = before.filter(~mid)
    assert untouched.exceptAll(after.filter(~mid)).isEmpty()
    cols = after.columns
    want = {tuple(r) for r in J.intraday_load(changed).select(cols).collect()}
    got = {tuple(r) for r in after.filter(mid).select(cols).collect()}
    old = {tuple(r) for r in before.filter(mid).select(cols).collect()}
    assert got == want and got != old                             # replaced, values changed


def _root(spark, name):
    return scratch_path(spark, name)


def _daily(spark, root):
    return stored(spark, root, "daily").drop("j_year", "j_month")


def test_ingest_of_several_days_and_out_of_order_replace_equals_one_pass(spark):
    snap = FX.snapshots(spark, SF_SMALL)
    day = F.to_date("download")
    days = sorted(r.d for r in snap.select(day.alias("d")).distinct().orderBy("d").limit(8).collect())
    root, lists = _root(spark, "ingest-many"), FX.ticker_lists(spark, SF_SMALL)
    part = snap.filter(day <= F.lit(days[-1]))
    first = part.filter(day.isin(days[0], days[1], days[3]))
    J.run_ingest(spark, first, root, block_list=lists[0], basket=lists[1])
    J.run_ingest(spark, part.filter(day.isin(days[4:])), root, block_list=lists[0],
                 basket=lists[1])
    J.run_ingest(spark, part.filter(day == F.lit(days[2])), root, "replace",
                 block_list=lists[0], basket=lists[1])   # a late day in the middle
    batch = J.daily_load(part)
    daily = _daily(spark, root).select(batch.columns)
    assert daily.count() == batch.count()
    assert daily.exceptAll(batch).isEmpty() and batch.exceptAll(daily).isEmpty()


def test_conflict_in_the_last_table_leaves_all_untouched(spark):
    snap = FX.snapshots(spark, SF_SMALL)
    day = F.to_date("download")
    days = sorted(r.d for r in snap.select(day.alias("d")).distinct().orderBy("d").limit(2).collect())
    root, lists = _root(spark, "ingest-atomic"), FX.ticker_lists(spark, SF_SMALL)
    J.run_ingest(spark, snap.filter(day == F.lit(days[0])), root, block_list=lists[0],
                 basket=lists[1], run_id="one")
    second = snap.filter(day == F.lit(days[1]))
    # only the index table already knows the second day
    tx = Transaction(spark, root)
    tx.write("index", J.market_load(second, *lists).withColumn("date", F.to_date("timestamp")),
             ["date"])
    tx.commit()
    at = version(spark, root)
    before = {k: stored(spark, root, k).count() for k in ("daily", "intraday", "index")}
    with pytest.raises(DuplicateKeyError):
        J.run_ingest(spark, second, root, block_list=lists[0], basket=lists[1], run_id="two")
    assert before == {k: stored(spark, root, k).count() for k in before}
    assert version(spark, root) == at


def test_trimmed_tickers_are_one_key(spark):
    snap = FX.snapshots(spark, SF_SMALL)
    spaced = snap.withColumn("ticker", F.when(F.minute("download") % 2 == 0, F.concat(
        F.col("ticker"), F.lit(" "))).otherwise(F.col("ticker")))
    want, got = J.daily_load(snap), J.daily_load(spaced)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_reports_choose_days_from_the_stored_sessions(spark):
    """Same frames with and without the session table, and with it one scan of
    the intraday table."""
    snap = FX.snapshots(spark, SF_SMALL)
    root, lists = _root(spark, "ingest-sessions"), FX.ticker_lists(spark, SF_SMALL)
    J.run_ingest(spark, snap, root, block_list=lists[0], basket=lists[1])
    intraday, daily = stored(spark, root, "intraday"), _daily(spark, root)
    days = J.stored_tables(spark, root)["sessions"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole paths in plans
    assert days.count() == intraday.select("ticker", "date").distinct().count()
    for make in (lambda **k: R.stock_buy_power_candles(intraday, daily, **k),
                 lambda **k: R.stock_per_capita_candles(intraday, daily, **k),
                 lambda **k: R.stock_last_session(intraday, **k)):
        with_index, without = make(sessions=days), make()
        assert with_index.count() == without.count() > 0
        assert with_index.exceptAll(without).isEmpty()
        assert scans(with_index, f"{root}/intraday/") == 1
    spec = SPECS["divergence_off_limit"]
    current = latest_per_key(snap, ["ticker"], "download", 1)
    hits = screen(current, spec, intraday=intraday, sessions=days, ordered=False)
    assert scans(hits, f"{root}/intraday/") == 1
    assert {r.ticker for r in hits.collect()} == {
        r.ticker for r in screen(current, spec, intraday=intraday).collect()}
