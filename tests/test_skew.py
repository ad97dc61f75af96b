"""A ticker holding a third of all rows: results stay exact, and every
operator over raw rows reduces the hot key map-side before its shuffle."""
import datetime as dt
import random

import pandas as pd

from tapeflow.operators.candles import indicator_candles
from tapeflow.operators.windows import last_session
from tapeflow.plans.explain import plan_text


def hot_flow(spark):
    random.seed(3)
    rows = []
    start = dt.datetime(2024, 1, 1, 9)
    for i in range(6000):
        t = "HOT" if i % 3 == 0 else f"T{i % 40}"
        ts = start + dt.timedelta(days=i % 90, seconds=i)
        v = None if random.random() < 0.1 else random.randint(-50, 50)
        rows.append((t, ts, v))
    pdf = pd.DataFrame(rows, columns=["ticker", "timestamp", "v"])
    df = spark.createDataFrame(rows, "ticker string, timestamp timestamp_ntz, v int").repartition(8)
    return df, pdf


def brute_candles(pdf, latest=None):
    pdf = pdf.assign(date=pdf["timestamp"].dt.date)
    out = []
    for (t, d), g in pdf.groupby(["ticker", "date"]):
        nn = g.dropna(subset=["v"]).sort_values("timestamp")
        out.append((t, d, g["v"].max(), g["v"].min(),
                    nn["v"].iloc[0] if len(nn) else None, nn["v"].iloc[-1] if len(nn) else None))
    c = pd.DataFrame(out, columns=["ticker", "date", "high", "low", "open", "close"])
    if latest:
        c = c.sort_values("date", ascending=False).groupby("ticker").head(latest)
    return {tuple(None if pd.isna(x) else x for x in r)
            for r in c.dropna(subset=["open"]).itertuples(index=False)}


def as_set(df):
    return {tuple(r) for r in df.select("ticker", "date", "high", "low", "open", "close").collect()}


def plan(df):
    df.collect()
    return plan_text(df)


def test_hot_key_candles_exact_and_pre_reduced(spark):
    df, pdf = hot_flow(spark)
    full = indicator_candles(df, "v")
    assert as_set(full) == brute_candles(pdf)
    p = plan(full)
    assert "partial_min_by" in p or "partial_max" in p      # map-side partial aggregation
    latest = indicator_candles(df, "v", latest=7)
    assert as_set(latest) == brute_candles(pdf, latest=7)
    assert "WindowGroupLimit" in plan(latest)


def test_hot_key_last_session(spark):
    df, pdf = hot_flow(spark)
    got = last_session(df).groupBy("ticker").count()
    last_day = pdf.assign(d=pdf["timestamp"].dt.date)
    want = last_day[last_day["d"] == last_day.groupby("ticker")["d"].transform("max")] \
        .groupby("ticker").size().to_dict()
    assert {r["ticker"]: r["count"] for r in got.collect()} == want
    p = plan(last_session(df))
    assert "partial_max" in p
