import datetime as dt

from pyspark.sql import functions as F

from tapeflow.functions import metrics as M
from tapeflow.plans.explain import plan_text
from tapeflow.session import scratch_path
from tapeflow.sources.snapshots import (
    normalise_name, quarantine, read_flow, read_snapshots, write_snapshot)
from tapeflow.schemas import SNAPSHOT


def test_normalise_names():
    assert normalise_name("Close(%)") == "close_percent"
    assert normalise_name("Trade Type") == "trade_type"
    assert normalise_name("VOL_BUY_R") == "vol_buy_r"


def test_read_landed_csv_with_jalali_download(spark):
    path = scratch_path(spark, "landed-csv")
    header = ("Symbol,Trade Type,Market,Time,Download,Open,High,Low,Close,Final,Day_UL,Day_LL,"
              "Close(%),Final(%),Volume,Vol_Buy_R,Vol_Sell_R,Vol_Buy_I,Vol_Sell_I,No_Buy_R,"
              "No_Sell_R,EPS")
    lines = [header,
             " فولاد,عادی,بورس,9:5:3,1402-01-01 09:05:07,100,110,90,105,104,110,90,"
             "5,4,1000,600,500,400,500,3,5,10",
             "خودرو,عادی,بورس,10:00:00,1400-12-30 10:00:00,100,110,90,105,104,110,90,"
             "5,4,1000,600,500,400,500,3,5,10",
             "شستا,عادی,بورس,10:00:00,1402-01-05 10:00:00,n/a,110,90,105,104,110,90,"
             "5,4,1000,600,500,400,500,3,5,10"]
    spark.sparkContext.parallelize(lines, 1).saveAsTextFile(path)
    snap = read_snapshots(spark, path, fmt="csv", index_name="symbol", header=True)
    assert snap.drop("bad_values").schema == SNAPSHOT
    ok, bad = quarantine(snap)
    assert ok.schema == SNAPSHOT
    good = ok.first()
    assert good.ticker == "فولاد" and good.time == "09:05:03"
    assert good.download == dt.datetime(2023, 3, 21, 9, 5, 7)
    # 1400-12-30 does not exist, and "n/a" is no number: both keep their text
    assert sorted(x for r in bad.collect() for x in r.bad_values) == [
        "download=1400-12-30 10:00:00", "open=n/a"]
    junk = bad.filter("ticker = 'شستا'").first()
    assert junk.open is None and junk.high == 110.0

    out = scratch_path(spark, "snap-store")
    write_snapshot(ok, out)
    assert spark.read.parquet(out).count() == 1

    from tapeflow.plans.jobs import run_ingest
    tables = run_ingest(spark, snap, scratch_path(spark, "ingest-csv"))
    assert tables["quarantine"].count() == 2
    assert tables["intraday"].count() == 1


def test_read_flow_fills_missing_columns(spark):
    path = scratch_path(spark, "flow-v1")
    spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 9), 5)],
                          "ticker string, timestamp timestamp_ntz, last_price int") \
        .write.parquet(path)
    df = read_flow(spark, path, "intraday")
    r = df.first()
    assert r.last_price == 5 and r.volume is None and "last_percent" in df.columns


def test_write_snapshot_replace_and_history(spark):
    from tapeflow.sources import fixtures as FX
    snap = FX.snapshots(spark, "/root/testdata/sf0.001")
    day = snap.select(F.to_date("download").alias("d")).agg(F.min("d")).first()[0]
    first = snap.filter(F.to_date("download") == F.lit(day))
    rest = snap.filter(F.to_date("download") > F.lit(day))
    replace_path = scratch_path(spark, "snap-replace")
    write_snapshot(first, replace_path, keep_history=False)
    write_snapshot(rest, replace_path, keep_history=False)        # replaces (S3)
    assert spark.read.parquet(replace_path).count() == rest.count()
    hist_path = scratch_path(spark, "snap-history")
    write_snapshot(first, hist_path)
    write_snapshot(rest, hist_path)                                # appends by capture date
    stored = spark.read.parquet(hist_path)
    assert stored.count() == snap.count()
    assert stored.filter(F.col("capture_date") == F.lit(day)).count() == first.count()


def test_latest_capture_prunes_to_newest(spark):
    from tapeflow.sources.snapshots import latest_capture
    from tapeflow.sources import fixtures as FX
    snap = FX.snapshots(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, "snap-latest")
    write_snapshot(snap, path)
    stored = spark.read.parquet(path)
    newest = latest_capture(stored)
    top = snap.agg(F.max("download")).first()[0]
    assert [r.download for r in newest.collect()] == [top]
    assert "PartitionFilters: [isnotnull(capture_date" in plan_text(newest)
