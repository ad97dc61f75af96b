import datetime as dt
import os

from pyspark.sql import functions as F

from tapeflow.cli import main
from tapeflow.operators.screens import screen
from tapeflow.operators.windows import latest_per_key
from tapeflow.plans.explain import plan_text
from tapeflow.plans.screens import SPECS
from tapeflow.session import scratch_path
from tapeflow.sources import fixtures as FX
from tapeflow.sources.snapshots import latest_capture, read_snapshots, write_snapshot
from tests.conftest import SF_SMALL


def test_cli_end_to_end(spark):
    captures = scratch_path(spark, "cli-captures")
    FX.snapshots(spark, SF_SMALL).write.parquet(captures)
    root = scratch_path(spark, "cli-root")
    out = scratch_path(spark, "cli-out")
    assert main(["ingest", "--captures", captures, "--root", root]) == 0
    assert main(["screen", "smart_money_short", "--captures", captures, "--root", root,
                 "--out", f"{out}/q2", "--show", "3", "--all-captures"]) == 0
    assert spark.read.parquet(f"{out}/q2").count() == 4      # FIXTURES §5, sf0.001
    assert main(["screen", "all", "--captures", captures, "--root", root,
                 "--out", f"{out}/all", "--all-captures"]) == 0
    per_screen = {r.screen: r["count"] for r in
                  spark.read.parquet(f"{out}/all").groupBy("screen").count().collect()}
    assert per_screen.get("smart_money_short") == 4 and per_screen.get("volatile_limit_up") == 1
    assert main(["report", "stock", "--root", root, "--out", f"{out}/stock",
                 "--tickers", "S1,S2"]) == 0
    vals = spark.read.parquet(f"{out}/stock/valuation")
    assert {r.ticker for r in vals.collect()} <= {"S1", "S2"} and vals.count() > 0
    assert main(["report", "market", "--root", root, "--out", f"{out}/market"]) == 0
    assert main(["report", "candidates", "--captures", captures, "--root", root,
                 "--out", f"{out}/cand", "--all-captures"]) == 0
    assert {"j_year", "j_month", "j_day"} <= set(
        spark.read.parquet(f"{out}/stock/price_candles").columns)
    for sub in ("stock/buy_power_candles", "market/candles", "cand/price_candles"):
        assert os.path.isdir(os.path.join(out, sub).replace("file:", ""))


def test_screens_see_the_newest_capture_only(spark):
    """Two whole-market captures; a ticker of the first one that passes is
    missing from the second (delisted): it must not pass any more."""
    snap = latest_per_key(FX.snapshots(spark, SF_SMALL), ["ticker"], "download", 1)
    hits = [r.ticker for r in screen(snap, SPECS["smart_money_short"]).collect()]
    captures, out = scratch_path(spark, "cli-two"), scratch_path(spark, "cli-two-out")
    at = [F.lit(dt.datetime(2024, 5, d, 10)).cast("timestamp_ntz") for d in (1, 2)]
    write_snapshot(snap.withColumn("download", at[0]), captures)
    write_snapshot(snap.withColumn("download", at[1]).filter(F.col("ticker") != hits[0]), captures)
    args = ["screen", "smart_money_short", "--captures", captures,
            "--root", scratch_path(spark, "none"), "--out", out]
    assert main(args) == 0
    assert {r.ticker for r in spark.read.parquet(out).collect()} == set(hits[1:])
    assert main([*args, "--all-captures"]) == 0
    assert {r.ticker for r in spark.read.parquet(out).collect()} == set(hits)
    plan = plan_text(latest_capture(read_snapshots(spark, captures)))
    assert "PartitionFilters: [isnotnull(capture_date" in plan
