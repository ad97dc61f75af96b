from pyspark.sql import functions as F

from tapeflow.functions import metrics as M
from tapeflow.operators import universe as U
from tapeflow.operators.flows import daily_rows, to_intraday_flow
from tapeflow.schemas import SNAPSHOT
from tests.conftest import rows


def snap(spark, *overrides):
    base = dict(ticker="A", trade_type="عادی", market="main", time="10:00:00",
                download=None, open=100.0, high=110.0, low=90.0, close=105.0, final=104.0,
                day_ul=110.0, day_ll=90.0, close_percent=5.0, final_percent=4.0, volume=1000,
                vol_buy_r=600.0, vol_sell_r=500.0, vol_buy_i=400.0, vol_sell_i=500.0,
                no_buy_r=3.0, no_sell_r=5.0, eps=10)
    data = []
    for o in overrides:
        r = dict(base)
        r.update(o)
        data.append(tuple(r[f.name] for f in SNAPSHOT.fields))
    return spark.createDataFrame(data, SNAPSHOT)


def test_safe_division_zero_buyers_sellers(spark):
    df = snap(spark, {"ticker": "zb", "no_buy_r": 0.0}, {"ticker": "zs", "no_sell_r": 0.0},
              {"ticker": "zv", "volume": 0})
    got = {r["ticker"]: r for r in rows(df.select(
        "ticker", M.buy_power().alias("p"), M.buy_per_capita().alias("b"),
        M.sell_per_capita().alias("s"), M.buy_ratio().alias("br")))}
    assert got["zb"]["p"] is None and got["zb"]["b"] is None
    assert got["zs"]["p"] is None and got["zs"]["s"] is None
    assert got["zv"]["br"] is None and got["zv"]["p"] is not None


def test_half_even_int_and_half_up_long(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (0.5,)], "x double")
    out = df.select(M.to_int("x").alias("i"), M.to_long_half_up("x").alias("l")).collect()
    assert [r.i for r in out] == [2, 4, -2, 0]
    assert [r.l for r in out] == [3, 4, -3, 1]


def test_clean_ticker_no_break_space(spark):
    df = spark.createDataFrame([(" فولاد  ",), (" x",)], "t string")
    assert [r.t for r in df.select(M.clean_ticker("t").alias("t")).collect()] == ["فولاد", "x"]


def test_rename_trap_and_stored_types(spark):
    r = daily_rows(snap(spark, {"download": None})).first()
    assert r.last == 105 and r.close == 104   # snapshot close → last, final → close
    i = to_intraday_flow(snap(spark, {})).first()
    assert i.last_price == 105


def test_tradable_keeps_null_market(spark):
    df = snap(spark, {"ticker": "n", "market": None}, {"ticker": "etf", "market": "صندوق قابل معامله"},
              {"ticker": "blk", "trade_type": "بلوکی", "market": None},
              {"ticker": "base", "market": "پایه"})
    assert {r.ticker for r in U.tradable(df).collect()} == {"n", "base"}
    assert {r.ticker for r in U.tradable(df, drop_base=True).collect()} == {"n"}


def test_session_window_inclusive(spark):
    df = snap(spark, *[{"ticker": t, "time": t} for t in
                       ("08:59:59", "09:00:00", "14:00:00", "14:00:01")], {"ticker": "null", "time": None})
    assert {r.ticker for r in U.in_session(df).collect()} == {"09:00:00", "14:00:00", "null"}


def test_has_opened(spark):
    df = snap(spark, {"ticker": "z", "open": 0.0}, {"ticker": "n", "open": None}, {"ticker": "o"})
    assert {r.ticker for r in U.has_opened(df).collect()} == {"n", "o"}


def test_ticker_lists(spark):
    df = snap(spark, {"ticker": "فولاد"}, {"ticker": "آسیاتک"}, {"ticker": "other"})
    assert {r.ticker for r in U.exclude_tickers(df, U.block_list(spark)).collect()} == \
        {"فولاد", "other"}
    assert {r.ticker for r in U.only_tickers(df, U.large_cap_basket(spark)).collect()} == {"فولاد"}
    assert len(U.MARKET_BLOCK_LIST) == 55 and len(U.LARGE_CAP_BASKET) == 13
    assert not set(U.MARKET_BLOCK_LIST) & set(U.LARGE_CAP_BASKET)


def test_flow_filter_null_drops(spark):
    df = snap(spark, {"ticker": "ok", "vol_buy_r": 5e7, "no_buy_r": 1.0, "vol_sell_r": 1e6,
                      "no_sell_r": 1.0},
              {"ticker": "null", "vol_buy_r": 5e7, "no_buy_r": 0.0})
    out = df.filter(U.strong_flow(1.5, 25, 0.05))
    assert [r.ticker for r in out.collect()] == ["ok"]
