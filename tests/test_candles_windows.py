import datetime as dt
import random

from pyspark.sql import functions as F

from tapeflow.operators.candles import (
    calendar_gaps, candle_geometry, candles_multi, indicator_candles, stacked_candles)
from tapeflow.operators.windows import (
    appended_average_volume, last_session, latest_sessions, with_average_volume)
from tests.conftest import rows

T = dt.datetime


def flow(spark, data):
    return spark.createDataFrame(data, "ticker string, timestamp timestamp_ntz, v int")


def test_candle_first_last_non_null_by_time(spark):
    f = flow(spark, [
        ("A", T(2024, 1, 1, 9, 0), None), ("A", T(2024, 1, 1, 9, 1), 5),
        ("A", T(2024, 1, 1, 9, 2), 9), ("A", T(2024, 1, 1, 9, 3), 2),
        ("A", T(2024, 1, 1, 9, 4), None),
        ("A", T(2024, 1, 2, 9, 0), 7),                          # single tick
        ("A", T(2024, 1, 3, 9, 0), None), ("A", T(2024, 1, 3, 9, 5), None),  # all NULL
    ])
    got = rows(indicator_candles(f, "v"), ["date"])
    assert [(r["date"].day, r["high"], r["low"], r["open"], r["close"]) for r in got] == \
        [(1, 9, 2, 5, 2), (2, 7, 7, 7, 7)]
    # the all-NULL latest day still uses one of the latest-n slots
    latest2 = rows(indicator_candles(f, "v", latest=2), ["date"])
    assert [r["date"].day for r in latest2] == [2]


def test_candles_order_free(spark):
    random.seed(7)
    base = [("T%d" % (i % 5), T(2024, 1, 1 + i % 4, 9, 0) + dt.timedelta(seconds=i),
             random.choice([None, *range(-20, 50)])) for i in range(400)]
    shuffled = base[:]
    random.shuffle(shuffled)
    a = indicator_candles(flow(spark, base).repartition(7), "v")
    b = indicator_candles(flow(spark, shuffled).coalesce(1), "v")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    bad = a.filter((F.col("low") > F.col("open")) | (F.col("open") > F.col("high"))
                   | (F.col("low") > F.col("close")) | (F.col("close") > F.col("high")))
    assert bad.isEmpty()


def test_stacked_equals_single(spark):
    f = flow(spark, [("A", T(2024, 1, 1, 9, i), i * 3 % 7) for i in range(10)])
    f = f.withColumn("w", -F.col("v"))
    st = stacked_candles(f, ["v", "w"])
    one = indicator_candles(f, "w").select(F.lit("w").alias("indicator"), "ticker", "date",
                                           *[F.col(c).cast("double") for c in
                                             ("high", "low", "open", "close")])
    assert st.filter("indicator = 'w'").select(one.columns).exceptAll(one).isEmpty()
    assert set(candles_multi(f, {"b": "v"}).columns) >= {"b_high", "b_low", "b_open", "b_close"}


def daily(spark, vols, ticker="A"):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(ticker, start + dt.timedelta(days=i), v) for i, v in enumerate(vols)],
        "ticker string, date date, volume bigint")


def test_average_volume_excludes_today_and_rounds_half_up(spark):
    got = rows(with_average_volume(daily(spark, [10, 11, 20, None, 5])), ["date"])
    assert [r["average_volume"] for r in got] == [None, 10, 11, 14, 14]
    # 10, 11 → 10.5 → 11 (half up); 10, 11, 20 → 13.67 → 14; NULL volume ignored


def test_average_volume_window_is_42(spark):
    vols = list(range(1, 60))
    got = rows(with_average_volume(daily(spark, vols)), ["date"])
    # row 50 (value 51): mean of the 42 values 9..50 = 29.5 → 30
    assert got[50]["average_volume"] == 30


def test_average_volume_of_an_appended_batch_equals_one_pass(spark):
    """A batch of several days, also one in the middle of the stored days."""
    whole = daily(spark, list(range(1, 80))).unionByName(daily(spark, [7, 9, 4], "B"))
    one_pass = {(r["ticker"], r["date"]): r["average_volume"]
                for r in rows(with_average_volume(whole, 5))}
    day = F.datediff("date", F.lit(dt.date(2024, 1, 1)))
    for in_batch in (day >= 70, day.between(30, 33), day % 9 == 4, day == 0):
        batch, refreshed = appended_average_volume(whole.filter(in_batch),
                                                   whole.filter(~in_batch), 5)
        got = rows(batch.select("ticker", "date", "average_volume")) + rows(refreshed)
        assert all(one_pass[r["ticker"], r["date"]] == r["average_volume"] for r in got)
        assert batch.count() == whole.filter(in_batch).count()
        # what is not refreshed keeps the average it had without the batch
        before = {(r["ticker"], r["date"]): r["average_volume"]
                  for r in rows(with_average_volume(whole.filter(~in_batch), 5))}
        changed = {k for k, v in before.items() if one_pass[k] != v}
        assert changed <= {(r["ticker"], r["date"]) for r in rows(refreshed)}


def test_latest_sessions_and_short_history(spark):
    d = daily(spark, [1, 2, 3]).unionByName(daily(spark, list(range(10)), "B"))
    got = rows(latest_sessions(d, 5), ["ticker", "date"])
    assert [r["ticker"] for r in got].count("A") == 3
    assert [r["volume"] for r in got if r["ticker"] == "B"] == [5, 6, 7, 8, 9]


def test_last_session_keeps_all_rows_of_last_day(spark):
    f = flow(spark, [("A", T(2024, 1, 1, 9), 1), ("A", T(2024, 1, 2, 9), 2),
                     ("A", T(2024, 1, 2, 10), 3), ("B", T(2024, 1, 1, 9), 4)])
    assert sorted(r["v"] for r in rows(last_session(f))) == [2, 3, 4]


def test_calendar_gaps(spark):
    d = spark.createDataFrame([("A", dt.date(2024, 3, 18)), ("A", dt.date(2024, 3, 21))],
                              "ticker string, date date")
    got = rows(calendar_gaps(d), ["date"])
    assert [r["date"].day for r in got] == [19, 20]
    assert (got[1]["j_year"], got[1]["j_month"], got[1]["j_day"]) == (1403, 1, 1)


def test_candle_geometry(spark):
    c = spark.createDataFrame([(10, 15, 8, 12), (10, 15, 8, 9)],
                              "open int, high int, low int, close int")
    got = rows(candle_geometry(c), ["close"])
    down, up = got
    assert (up["body_bottom"], up["body_height"], up["upper_bottom"], up["upper_height"],
            up["lower_bottom"], up["lower_height"]) == (10, 2, 12, 3, 10, -2)
    assert (down["body_height"], down["upper_bottom"], down["upper_height"],
            down["lower_bottom"], down["lower_height"]) == (-1, 10, 5, 9, -1)
