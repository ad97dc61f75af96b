import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeflow.functions import metrics as M
from tapeflow.plans.reports import stock_valuation


def test_valuation_and_display(spark):
    daily = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1), 10, 1000, 100, 50, 200),
         ("A", dt.date(2024, 1, 2), 12345, 1000, 200, 50, 12345),
         ("Z", dt.date(2024, 1, 2), 500, 0, 0, None, 500)],
        "ticker string, date date, last int, volume bigint, eps int, average_volume bigint, "
        "close int")
    got = {r.ticker: r for r in stock_valuation(daily, display=True).collect()}
    a = got["A"]
    assert a.date == dt.date(2024, 1, 2) and a.eps == 200
    assert a.pe == 12345 / 200 and a.pe_display == 61.72          # half even at 2 digits
    assert math.isclose(a.trade_value, 1000 * 12345 / 1e10)
    assert math.isclose(a.avg_trade_value, 50 * 12345 / 1e10)
    z = got["Z"]
    assert z.pe is None and z.pe_display is None and z.avg_trade_value is None


def test_market_cap(spark):
    df = spark.createDataFrame([(25_000_000_000.0,), (None,)], "market_cap double")
    assert [r.m for r in df.select(M.market_cap().alias("m")).collect()] == [2, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False)
                .map(lambda x: round(x * 2) / 2), min_size=1, max_size=60))
def test_int_cast_is_half_even(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r.i for r in df.select(M.to_int("x").alias("i")).collect()]
    assert got == [round(x) for x in xs]          # Python round() is half-even
