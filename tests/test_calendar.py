import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeflow.functions import calendar as C
from tests.conftest import rows

# FIXTURES §4: Jalali → Gregorian, all confirmed against the arithmetic.
GOLDEN = [
    ((1357, 11, 22), dt.date(1979, 2, 11)),
    ((1375, 1, 1), dt.date(1996, 3, 20)),
    ((1376, 1, 1), dt.date(1997, 3, 21)),
    ((1399, 1, 1), dt.date(2020, 3, 20)),
    ((1399, 12, 30), dt.date(2021, 3, 20)),
    ((1400, 1, 1), dt.date(2021, 3, 21)),
    ((1401, 1, 1), dt.date(2022, 3, 21)),
    ((1401, 2, 31), dt.date(2022, 5, 21)),
    ((1402, 1, 1), dt.date(2023, 3, 21)),
    ((1403, 1, 1), dt.date(2024, 3, 20)),
    ((1404, 1, 1), dt.date(2025, 3, 21)),
]


def test_golden_forward_and_back(spark):
    df = spark.createDataFrame([(y, m, d, g) for (y, m, d), g in GOLDEN],
                               "jy int, jm int, jd int, g date")
    out = df.select("*", C.jalali_to_date("jy", "jm", "jd").alias("to_g"),
                    C.date_to_jalali("g").alias("j"))
    for r in out.collect():
        assert r.to_g == r.g
        assert (r.j.j_year, r.j.j_month, r.j.j_day) == (r.jy, r.jm, r.jd)


def test_epoch_zero(spark):
    r = spark.range(1).select(C.date_to_jalali(F.date_from_unix_date(F.lit(0))).alias("j")).first()
    assert (r.j.j_year, r.j.j_month, r.j.j_day) == (1348, 10, 11)


def test_round_trip_and_monotone(spark):
    days = spark.range(-60000, 90000).select(F.col("id").cast("int").alias("e"))
    d = days.select("e", F.date_from_unix_date("e").alias("g"))
    j = C.with_jalali_fields(d, "g")
    back = j.select("e", "g", "j_year", "j_month", "j_day",
                    C.jalali_epoch_day("j_year", "j_month", "j_day").alias("e2"),
                    C.date_to_jalali("g").alias("col_form"))
    bad = back.filter((F.col("e2") != F.col("e"))
                      | (F.col("col_form.j_year") != F.col("j_year"))
                      | (F.col("col_form.j_month") != F.col("j_month"))
                      | (F.col("col_form.j_day") != F.col("j_day")))
    assert bad.isEmpty()


@pytest.mark.parametrize("text,expected", [
    ("1401-02-31", dt.date(2022, 5, 21)),   # valid: month 2 has 31 days
    ("1400-12-30", None),                    # 1400 is not a leap year
    ("1399-12-30", dt.date(2021, 3, 20)),   # 1399 is
    ("1400-07-31", None),                    # month 7 has 30 days
    ("1400-13-01", None),
    ("garbage", None),
])
def test_parse_validity(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    col_form = df.select(C.parse_jalali_date("t").alias("d")).first().d
    df_form = C.with_jalali_parsed(df, "t", "d").first().d
    assert col_form == expected == df_form


def test_download_and_minute(spark):
    df = spark.createDataFrame([("1402-01-01 09:05:07",), ("1400-12-30 10:00:00",)], "t string")
    out = df.select(C.parse_download("t").alias("ts"), C.jalali_to_minute("t").alias("m"))
    got = out.collect()
    assert got[0].ts == dt.datetime(2023, 3, 21, 9, 5, 7)
    assert got[0].m == dt.datetime(2023, 3, 21, 9, 5)
    assert got[1].ts is None and got[1].m is None
    df_form = C.with_jalali_parsed(df, "t", "ts", kind="timestamp").collect()
    assert [r.ts for r in df_form] == [got[0].ts, None]


def test_normalise_time(spark):
    df = spark.createDataFrame([("9:5:3",), ("14:00:00",), (None,)], "t string")
    assert [r.t for r in df.select(C.normalise_time("t").alias("t")).collect()] == \
        ["09:05:03", "14:00:00", None]


@pytest.mark.parametrize("text", ["1402-01-01 25:61:00", "1402-01-01 1x:00:00", "1402-01-01 10",
                                  "1402-01-01 10:00:60", "1402-01-01 100:00:00", "1402-01"])
def test_impossible_times_are_null(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(C.parse_download("t").alias("ts"), C.jalali_to_minute("t").alias("m")).first()
    assert r.ts is None and r.m is None
    for kind in ("timestamp", "minute"):
        assert C.with_jalali_parsed(df, "t", "ts", kind=kind).first().ts is None


def test_fractions_of_a_second_are_kept(spark):
    df = spark.createDataFrame([("1402-01-01 09:05:07.25",), ("1402-01-01 09:05",)], "t string")
    want = [dt.datetime(2023, 3, 21, 9, 5, 7, 250000), dt.datetime(2023, 3, 21, 9, 5)]
    assert [r.x for r in df.select(C.parse_download("t").alias("x")).collect()] == want
    assert [r.x for r in C.with_jalali_parsed(df, "t", "x", kind="timestamp").collect()] == want


def test_junk_is_no_time_of_day(spark):
    df = spark.createDataFrame([("junk",), ("100:00:00",), ("24:00:00",), ("7",)], "t string")
    assert [r.t for r in df.select(C.normalise_time("t").alias("t")).collect()] == \
        [None, None, None, "07:00:00"]


def test_jalali_text(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 20),)], "d date")
    r = df.select(C.jalali_text(C.date_to_jalali("d")).alias("t")).first()
    assert r.t == "1403-01-01"
