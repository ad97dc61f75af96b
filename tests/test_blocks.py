"""W2 over a stored table by prefix sums over month blocks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tapeflow.operators.blocks import BLOCK, appended_by_blocks, block_totals
from tapeflow.operators.windows import with_average_volume
from tapeflow.plans import jobs as J
from tapeflow.session import scratch_path, staged
from tapeflow.sources import fixtures as FX
from tapeflow.sources.versions import Transaction
from tests.conftest import SF_SMALL

START = datetime.date(2023, 3, 21)


def same(a, b):
    b = b.select(a.columns)
    return a.count() == b.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def daily(spark):
    """Tickers with gaps, short histories and NULL volumes."""
    rng = random.Random(3)
    rows = [(f"T{t}", START + datetime.timedelta(days=k), rng.choice([None, rng.randrange(10**9)]))
            for t in range(6) for k in range(400 if t else 20) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "ticker string, date date, volume long")
    return staged(J.with_session_month(df), "daily")


class Reader:
    """Stored rows by month, and the blocks that were read."""

    def __init__(self, rows):
        self.rows, self.months = rows, []

    def __call__(self, months):
        self.months.append(set(months))
        wanted = F.lit(False)
        for y, m in months:
            wanted = wanted | ((F.col("j_year") == y) & (F.col("j_month") == m))
        return self.rows.filter(wanted)


@pytest.mark.parametrize("n,share", [(42, 0.5), (42, 0.01), (1, 0.9)])
def test_any_batch_has_the_averages_of_one_pass(daily, n, share):
    in_batch = F.pmod(F.xxhash64("ticker", "date", F.lit(n)), F.lit(1000)) < int(1000 * share)
    batch, stored = daily.filter(in_batch), daily.filter(~in_batch)
    # stored rows of some batch keys, with other volumes, are replaced
    again = batch.filter(F.day("date") % 2 == 0).withColumn("volume", F.lit(7).cast("long"))
    stored = staged(stored.unionByName(again), "stored")
    out, fresh, totals = appended_by_blocks(batch, Reader(stored), block_totals(stored), n, True)
    whole = with_average_volume(daily, n)
    assert same(out, whole.filter(in_batch))
    keys = whole.filter(~in_batch).select("ticker", "date", "average_volume")
    assert same(fresh, keys.join(fresh.select("ticker", "date"), ["ticker", "date"]))
    before = with_average_volume(stored, n).select("ticker", "date", F.col("average_volume").alias("b"))
    changed = keys.join(before, ["ticker", "date"]).filter(~F.col("b").eqNullSafe(
        F.col("average_volume"))).select("ticker", "date")
    assert changed.join(fresh, ["ticker", "date"], "left_anti").isEmpty()
    assert same(totals, block_totals(daily).join(
        batch.select("j_year", "j_month").distinct(), ["j_year", "j_month"], "left_semi"))


def test_a_one_day_batch_reads_its_block_and_one_more(daily):
    late = daily.filter(F.col("date") > F.lit(START + datetime.timedelta(days=300)))
    day, n = late.groupBy("date").count().orderBy(F.desc("count"), "date").first()["date"], 100
    batch = staged(daily.filter(F.col("date") == F.lit(day)), "batch")
    stored = staged(daily.filter(F.col("date") != F.lit(day)), "stored")
    read = Reader(stored)
    out, fresh, _ = appended_by_blocks(batch, read, block_totals(stored), n)
    want = with_average_volume(daily, n).filter(F.col("date") == F.lit(day))
    assert fresh is None and out.count() > 2 and same(out, want)
    own, near = read.months
    assert len(own) == 1
    # months between the batch's and those 100 sessions before it are not read
    months = [tuple(r) for r in stored.filter(F.col("date") < F.lit(day)).select(
        "j_year", "j_month").distinct().orderBy("j_year", "j_month").collect()]
    assert near and len(near) <= 3 and max(near) < months[-3]


def test_empty_batch_and_empty_table(daily):
    nothing = daily.limit(0)
    out, fresh, totals = appended_by_blocks(nothing, Reader(daily), block_totals(daily), 42, True)
    assert out.isEmpty() and fresh.isEmpty() and totals.isEmpty()
    out, _, totals = appended_by_blocks(daily, Reader(nothing), block_totals(nothing))
    assert same(out, with_average_volume(daily)) and same(totals, block_totals(daily))


def test_stored_totals_follow_every_run(spark):
    snap, root = FX.snapshots(spark, SF_SMALL), scratch_path(spark, "daily-blocks")
    day = F.to_date("download")
    third = F.pmod(F.unix_date(day), F.lit(3))
    runs = [(snap.filter(third == 0), "error"), (snap.filter(third == 1), "replace"),
            (snap.filter(third != 1), "skip")]
    for rows, rule in runs:
        tx = Transaction(spark, root)
        J.daily_into(tx, rows, rule)
        tx.commit()
    tables = J.stored_tables(spark, root)
    totals = block_totals(tables["daily"])
    assert same(totals, tables["daily_blocks"])
    assert tables["daily_blocks"].select(*BLOCK).distinct().count() == totals.count() > 0
    assert same(J.daily_load(snap).drop("average_volume"), tables["daily"])


def test_a_batch_reads_only_folders_of_its_partitions(spark):
    snap, root = FX.snapshots(spark, SF_SMALL), scratch_path(spark, "daily-folders")
    tx = Transaction(spark, root)
    J.daily_into(tx, snap, "error")
    tx.commit()
    tx = Transaction(spark, root)
    months = J.months_of(tx.table("daily", J.SCHEMAS["daily"]))
    files = J.stored_months(tx, months[:1]).inputFiles()
    assert files and all(f"j_year={months[0][0]}/j_month={months[0][1]}/" in f for f in files)
    assert J.stored_months(tx, []).isEmpty()
