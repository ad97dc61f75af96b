import datetime as dt
import os

import pytest

from tapeflow.session import scratch_path
from tapeflow.sources.sinks import (
    DuplicateKeyError, append_unique, one_per_key, read_stored, union_evolved, write_unique)
from tests.conftest import rows


def tbl(spark, data):
    return spark.createDataFrame(data, "ticker string, date date, v int")


D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)


def test_conflict_modes(spark):
    old = tbl(spark, [("A", D1, 1), ("A", D2, 2)])
    new = tbl(spark, [("A", D2, 20), ("A", D3, 30)])
    with pytest.raises(DuplicateKeyError):
        append_unique(new, old, ["ticker", "date"], "error")
    skip = {(r["date"], r["v"]) for r in rows(append_unique(new, old, ["ticker", "date"], "skip"))}
    assert skip == {(D1, 1), (D2, 2), (D3, 30)}
    rep = {(r["date"], r["v"]) for r in rows(append_unique(new, old, ["ticker", "date"], "replace"))}
    assert rep == {(D1, 1), (D2, 20), (D3, 30)}
    fresh = tbl(spark, [("B", D1, 5)])
    assert append_unique(fresh, old, ["ticker", "date"], "error").count() == 3


def test_one_row_per_key_sorts_nothing_before_the_shuffle(spark):
    path = scratch_path(spark, "one-per-key")
    rows_ = [("A", D1, 1), ("A", D1, 2), ("A", None, 3), ("A", None, 4), (None, D2, 5), ("B", D2, 6)]
    tbl(spark, rows_ + rows_).write.parquet(path)
    one = one_per_key(spark.read.parquet(path), ["ticker", "date"])
    got = rows(one)
    assert {(r["ticker"], r["date"]) for r in got} == {r[:2] for r in rows_} and len(got) == 4
    assert all(tuple(r.values()) in rows_ for r in got)
    plan = spark.read.parquet(path).transform(one_per_key, ["ticker", "date"]) \
        ._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert plan.count("Exchange") == 1 and "Sort" not in below and "Limit" not in below


def test_union_evolved(spark):
    old = spark.createDataFrame([("A", 1)], "ticker string, v int")
    new = spark.createDataFrame([("B", 2, 3.5)], "ticker string, v int, extra double")
    got = {r["ticker"]: r["extra"] for r in rows(union_evolved(old, new))}
    assert got == {"A": None, "B": 3.5}


def test_write_unique_on_parquet(spark):
    path = scratch_path(spark, "sink-test")
    keys = ["ticker", "date"]
    write_unique(spark, tbl(spark, [("A", D1, 1), ("A", D2, 2)]), path, keys,
                 partition_by=["date"])
    with pytest.raises(DuplicateKeyError):
        write_unique(spark, tbl(spark, [("A", D2, 9)]), path, keys, partition_by=["date"])
    write_unique(spark, tbl(spark, [("A", D2, 9), ("A", D3, 3)]), path, keys, "skip",
                 partition_by=["date"])
    out = write_unique(spark, tbl(spark, [("A", D2, 22)]), path, keys, "replace",
                       partition_by=["date"])
    got = {(r["date"], r["v"]) for r in rows(out)}
    assert got == {(D1, 1), (D2, 22), (D3, 3)}
    assert os.path.isdir(path.replace("file:", ""))


def test_a_key_that_repeats_in_the_batch(spark):
    path, keys = scratch_path(spark, "sink-repeat"), ["ticker", "date"]
    twice = tbl(spark, [("A", D1, 1), ("A", D1, 2), ("B", D1, 3)])
    with pytest.raises(DuplicateKeyError):
        write_unique(spark, twice, path, keys)
    assert read_stored(spark, path) is None
    out = [rows(write_unique(spark, tbl(spark, data), scratch_path(spark, "s"), keys, "skip"),
                ["ticker"])
           for data in ([("A", D1, 1), ("A", D1, 2)], [("A", D1, 2), ("A", D1, 1)])]
    assert out[0] == out[1] and len(out[0]) == 1


def test_a_table_that_cannot_be_read_is_no_empty_table(spark, tmp_path):
    path = str(tmp_path / "table")
    write_unique(spark, tbl(spark, [("A", D1, 1)]), path, ["ticker", "date"])
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            with open(os.path.join(path, f), "wb") as out:
                out.write(b"not a parquet file")
    with pytest.raises(Exception) as e:
        write_unique(spark, tbl(spark, [("A", D1, 1)]), path, ["ticker", "date"])
    assert not isinstance(e.value, DuplicateKeyError)


def test_a_replay_writes_few_files_per_partition(spark, tmp_path):
    path = str(tmp_path / "replay")
    data = [(f"T{i % 50}", dt.date(2024, 1, 1 + i // 50), i) for i in range(1000)]
    write_unique(spark, tbl(spark, data).repartition(16), path, ["ticker", "date"],
                 partition_by=["date"])
    for d in os.listdir(path):
        if d.startswith("date="):
            files = [f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")]
            assert len(files) == 1
