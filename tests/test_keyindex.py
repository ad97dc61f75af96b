"""Key filters: a keyed append reads no stored row that cannot meet its keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeflow.session import scratch_path, staged
from tapeflow.sources import versions as V
from tapeflow.sources.keyindex import key_filters, may_be_stored
from tapeflow.sources.sinks import DuplicateKeyError

KEYS = ["ticker", "at"]


@pytest.fixture()
def read(monkeypatch):
    """Folders read by table, as they are asked for."""
    seen, real = [], V._read

    def recorded(spark, root, name, folders, schema=None):
        seen.extend((name, f) for f in folders)
        return real(spark, root, name, folders, schema)
    monkeypatch.setattr(V, "_read", recorded)
    return seen


def ticks(spark, lo, hi, days=3):
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.pmod("id", F.lit(days)).cast("int"))
    return spark.range(lo, hi).select(
        F.concat(F.lit("T"), F.pmod("id", F.lit(7))).alias("ticker"), F.col("id").alias("at"),
        F.lit(1).alias("v"), day.alias("date"))


def append(spark, root, rows, mode="skip", parts=("date",)):
    tx = V.Transaction(spark, root)
    tx.write_unique("t", rows, KEYS, mode, list(parts))
    tx.commit()
    return tx


@pytest.mark.parametrize("parts", [["date"], []])
def test_no_stored_key_is_missed_and_few_others_hit(spark, parts):
    stored = ticks(spark, 0, 3000)
    f = staged(key_filters(stored, KEYS, parts, "batch=a"), "filters")
    assert may_be_stored(stored.filter("at % 50 = 0"), f, KEYS, parts).count() == (3 if parts else 1)
    hits = 0
    for k in range(25):  # between the least and greatest key, never stored
        ticker, at, days = k % 7, 10 * k + 1, k % 3
        if at % 7 == ticker and (not parts or at % 3 == days):
            continue
        one = spark.createDataFrame([(f"T{ticker}", at)], "ticker string, at long").select(
            "*", F.lit(dt.date(2024, 1, 1) + dt.timedelta(days)).alias("date"))
        hits += may_be_stored(one, f, KEYS, parts).count()
    assert hits <= 2
    alone = ticks(spark, 77, 78)
    assert may_be_stored(alone, f, KEYS, parts).count() == 1


def test_a_batch_of_new_keys_reads_no_data(spark, read):
    root = scratch_path(spark, "new-keys")
    append(spark, root, ticks(spark, 0, 900))
    read.clear()
    append(spark, root, ticks(spark, 900, 1200), "error")
    # all live folders' filters are asked; the data read is the batch's own
    assert sum(n == "t_keys" for n, _ in read) == 3
    own = V.version(spark, root).tables["t"][3:]
    assert {f for n, f in read if n == "t"} == set(own)
    read.clear()
    with pytest.raises(DuplicateKeyError):
        append(spark, root, ticks(spark, 1199, 1201), "error")
    assert len([f for n, f in read if n == "t"]) <= 2       # of six live folders
    got = V.read_table(spark, root, "t")
    assert got.count() == 1200 and got.select(KEYS).distinct().count() == 1200


def test_folders_without_filters_are_read(spark, read):
    """A table from before there were filters, replaced partitions, compaction,
    a table without partitions, one dealt by text."""
    root = scratch_path(spark, "mixed")
    tx = V.Transaction(spark, root)
    tx.write("t", ticks(spark, 0, 300), ["date"], KEYS)
    tx.commit()
    append(spark, root, ticks(spark, 200, 600))
    assert V.read_table(spark, root, "t").count() == 600
    append(spark, root, ticks(spark, 300, 500).withColumn("v", F.lit(2)), "replace")
    append(spark, root, ticks(spark, 100, 700))
    t = V.read_table(spark, root, "t")
    assert t.count() == 700 and t.filter("v = 2").count() == 200
    assert V.compact(spark, root, "t", ["date"], KEYS, most=1) == 3
    live = V.version(spark, root).tables
    assert sorted(live["t"]) == sorted(live["t_keys"]) and len(live["t"]) == 3
    read.clear()
    append(spark, root, ticks(spark, 5000, 5100))
    assert not {f for n, f in read if n == "t"} & set(live["t"])
    for parts in ([], ["ticker"]):
        root = scratch_path(spark, "others")
        for lo, hi in ((0, 100), (100, 200), (150, 300), (0, 300)):
            append(spark, root, ticks(spark, lo, hi), "skip", parts)
        assert V.read_table(spark, root, "t").count() == 300
