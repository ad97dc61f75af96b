"""DuckDB twins of the registered queries (the correctness oracle).

Written as plain SQL over the driver tables, following the reference's
own SQL where it has one (PostgreSQL idioms translated: ``round_even`` for
the assignment cast to INT, ``//`` for ``div``, DECIMAL literals for the
1.3/1.2 divergence factors).  DuckDB's ``sum(bigint)`` is HUGEINT, so
sums are cast back to BIGINT.
"""

from __future__ import annotations

# Metric expressions (M1–M6) over the snapshot columns.
M1 = "((vol_buy_r/NULLIF(no_buy_r,0))/NULLIF((vol_sell_r/NULLIF(no_sell_r,0)),0))"
M2 = "(((vol_buy_r*final)/NULLIF(no_buy_r,0))/10000000)"
M3 = "(((vol_sell_r*final)/NULLIF(no_sell_r,0))/10000000)"
M4 = "(((vol_sell_i - vol_buy_i)*final)/10000000)"
M5 = "(vol_buy_r/NULLIF(volume,0))"
M6 = "(vol_sell_r/NULLIF(volume,0))"


def INT(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INTEGER)"


def REAL(x: str) -> str:
    return f"CAST({x} AS REAL)"


F1 = """NOT coalesce(trade_type IN ('بلوکی', 'عمده')
        OR market IN ('صندوق قابل معامله', 'حق تقدم بورس', 'حق تقدم فرابورس', 'حق تقدم پایه'), false)"""
F2 = """NOT coalesce(trade_type IN ('بلوکی', 'عمده')
        OR market IN ('صندوق قابل معامله', 'حق تقدم بورس', 'حق تقدم فرابورس', 'حق تقدم پایه', 'پایه'), false)"""
F3 = "NOT coalesce(time < '09:00:00' OR time > '14:00:00', false)"

# F-1: snapshot rows from events.
SNAP = f"""
ev AS (SELECT event_id AS e, ts, user_id, event_type,
              CAST(round(value*100) AS BIGINT) AS v FROM events),
snap0 AS (
  SELECT 'S' || CAST(user_id AS VARCHAR) AS ticker,
         CASE WHEN event_type = 'error' THEN 'بلوکی' ELSE 'عادی' END AS trade_type,
         CASE e % 10 WHEN 0 THEN 'صندوق قابل معامله' WHEN 1 THEN 'پایه'
                     WHEN 2 THEN NULL ELSE 'main' END AS market,
         strftime(ts, '%H:%M:%S') AS time,
         ts AS download,
         CASE WHEN e % 50 = 0 THEN 0.0 ELSE CAST(1000 + (v*7) % 400 AS DOUBLE) END AS open,
         CAST(1000 + v % 400 AS DOUBLE) AS close,
         CAST(1000 + (v*3) % 400 AS DOUBLE) AS final,
         e
  FROM ev),
snap AS (
  SELECT ticker, trade_type, market, time, download, open,
         greatest(open, close, final) + 5 AS high,
         least(CASE WHEN open = 0 THEN close ELSE open END, close, final) - 5 AS low,
         close, final,
         CASE WHEN e % 2 = 0 THEN close ELSE CAST(1400 AS DOUBLE) END AS day_ul,
         CAST(900 AS DOUBLE) AS day_ll,
         CAST((close - open) * 100.0 / NULLIF(open, 0) AS REAL) AS close_percent,
         CAST((final - open) * 100.0 / NULLIF(open, 0) AS REAL) AS final_percent,
         CAST(CAST(100000 + (e*7919) % 4000000 AS DOUBLE)
              + CAST((e*15485863) % 500000 AS DOUBLE) AS BIGINT) AS volume,
         CAST(100000 + (e*7919) % 4000000 AS DOUBLE) AS vol_buy_r,
         CAST(100000 + (e*104729) % 4000000 AS DOUBLE) AS vol_sell_r,
         CAST((e*15485863) % 500000 AS DOUBLE) AS vol_buy_i,
         CAST((e*32452843) % 500000 AS DOUBLE) AS vol_sell_i,
         CAST((e*31) % 17 AS DOUBLE) AS no_buy_r,
         CAST((e*37) % 19 AS DOUBLE) AS no_sell_r,
         CAST((e % 7 - 1) * 100 AS INTEGER) AS eps
  FROM snap0)"""

CUR = """
cur AS (SELECT * FROM snap
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY download DESC) = 1)"""

# M7 row projection (no average) of a snapshot-shaped relation.
DAILY_ROWS = f"""
  SELECT ticker, CAST(download AS DATE) AS date,
         {REAL(M1)} AS i_buy_pow, {INT(M2)} AS i_buy_per_capita, {INT(M3)} AS i_sell_per_capita,
         {INT('close')} AS last, close_percent AS last_percent,
         {INT('final')} AS close, final_percent AS close_percent,
         CAST(volume AS BIGINT) AS volume, {INT(M4)} AS i_entered_money, eps,
         {REAL(M5)} AS i_buy_ratio, {REAL(M6)} AS i_sell_ratio,
         {INT('open')} AS open, {INT('high')} AS high, {INT('low')} AS low,
         {INT('day_ul')} AS up_level, {INT('day_ll')} AS dawn_level"""


def daily_cte(name: str, source: str) -> str:
    """Daily history from the captures in ``source``: last row of each
    (ticker, day) → M7, with the exact 42-session average volume."""
    return f"""
{name}_last AS (SELECT * FROM {source}
    QUALIFY row_number() OVER (PARTITION BY ticker, CAST(download AS DATE)
                               ORDER BY download DESC) = 1),
{name}_rows AS ({DAILY_ROWS} FROM {name}_last),
{name}_w AS (SELECT *,
    CAST(sum(volume) OVER w AS BIGINT) AS _s, count(volume) OVER w AS _c
    FROM {name}_rows
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT * EXCLUDE (_s, _c),
    CASE WHEN _c > 0 THEN (2*_s + _c) // (2*_c) END AS average_volume FROM {name}_w)"""


DAILY = daily_cte("daily", "snap")

INTRADAY = f"""
intraday AS (
  SELECT ticker, download AS "timestamp", {INT('close')} AS last_price,
         {REAL(M1)} AS i_buy_pow, {INT(M2)} AS i_buy_per_capita, {INT(M3)} AS i_sell_per_capita,
         {INT(M4)} AS i_entered_money, {REAL(M5)} AS i_buy_ratio, {REAL(M6)} AS i_sell_ratio,
         close_percent AS last_percent, CAST(volume AS BIGINT) AS volume
  FROM snap)"""

# F-2: long daily table from lineitem ⋈ part, with the 42-session average.
LONG = """
li AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity,
              CAST(round(l_extendedprice*100) AS BIGINT) AS c
       FROM lineitem JOIN part ON l_partkey = p_partkey),
lg AS (SELECT ticker, date, CAST(sum(l_quantity) AS BIGINT) AS volume,
              min(c) AS lo, max(c) AS hi, count(*) AS n FROM li GROUP BY ticker, date),
long0 AS (SELECT ticker, date, volume, CAST(lo AS INTEGER) AS low, CAST(hi AS INTEGER) AS high,
                 CAST((lo + hi) // 2 AS INTEGER) AS open,
                 CAST(lo + ((hi - lo) * 3) // 4 AS INTEGER) AS last,
                 CAST(lo + ((hi - lo) * 3) // 4 AS INTEGER) AS close,
                 CAST((n % 5 - 1) * 100 AS INTEGER) AS eps FROM lg),
long_w AS (SELECT *, CAST(sum(volume) OVER w AS BIGINT) AS _s, count(volume) OVER w AS _c
           FROM long0
           WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)),
longd AS (SELECT * EXCLUDE (_s, _c),
                 CASE WHEN _c > 0 THEN (2*_s + _c) // (2*_c) END AS average_volume FROM long_w)"""

# F-3: hourly cross-sections after the ingest filters; ticker lists.
HOURLY = f"""
hsnap AS (SELECT * REPLACE (date_trunc('hour', download) AS download) FROM snap),
huni AS (SELECT * FROM hsnap WHERE {F1} AND {F3}),
block AS (SELECT DISTINCT 'S' || CAST(user_id AS VARCHAR) AS ticker FROM events WHERE user_id % 5 = 0),
basket AS (SELECT DISTINCT 'S' || CAST(user_id AS VARCHAR) AS ticker FROM events WHERE user_id % 5 = 1)"""


def index_select(universe: str, where: str) -> str:
    return f"""
  SELECT '{universe}' AS universe, download AS "timestamp",
         {REAL(f'avg({M2})/NULLIF(avg({M3}),0)')} AS i_buy_pow,
         {INT(f'avg({M2})')} AS i_buy_per_capita, {INT(f'avg({M3})')} AS i_sell_per_capita,
         {INT(f'sum({M4})')} AS i_entered_money
  FROM huni WHERE {where} GROUP BY download"""


MARKET_WHERE = "ticker NOT IN (SELECT ticker FROM block)"
LARGE_WHERE = MARKET_WHERE + " AND ticker IN (SELECT ticker FROM basket)"
INDEX = f"""
idx AS ({index_select('market', MARKET_WHERE)}
  UNION ALL {index_select('large', LARGE_WHERE)})"""


def candle_sql(value: str, prefix: str = "", ts: str = '"timestamp"') -> str:
    """A3 select list for one indicator (first/last non-null by time)."""
    return f"""max({value}) AS {prefix}high, min({value}) AS {prefix}low,
         arg_min({value}, {ts}) FILTER (WHERE {value} IS NOT NULL) AS {prefix}open,
         arg_max({value}, {ts}) FILTER (WHERE {value} IS NOT NULL) AS {prefix}close"""


def candles_cte(name: str, src: str, value: str, keys: str = "ticker",
                latest: int | None = None) -> str:
    body = f"""SELECT {keys}, CAST("timestamp" AS DATE) AS date, {candle_sql(value)}
               FROM {src} GROUP BY ALL"""
    if latest is not None:
        body = f"""SELECT * FROM ({body})
                   QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY date DESC) <= {latest}"""
    return f"{name} AS ({body})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


SCREEN_COLS = f"ticker, {M1} AS buy_power, {M2} AS buy_per_capita, {M3} AS sell_per_capita"


def stage(universe: str, pow_: str, buy: str, sell: str, max_sell: str | None,
          locked_by: str, at_limit: bool) -> str:
    cond = [universe, f"{M1} >= {pow_}", f"{M2} > {buy}", f"{M3} > {sell}"]
    if max_sell is not None:
        cond.append(f"{M3} < {max_sell}")
    cond.append(f"{locked_by} < day_ul")
    cond.append("close = day_ul" if at_limit else "close != day_ul")
    return f"stage AS (SELECT {SCREEN_COLS} FROM cur WHERE {' AND '.join(cond)})"


def persistence_cte(unlocked: bool) -> str:
    extra = " AND low < up_level" if unlocked else ""
    return f"""hits AS (SELECT ticker, count(date) FILTER (WHERE i_buy_pow >= 1{extra}
                   AND i_buy_per_capita > 15 AND i_sell_per_capita > 5) AS hits
                FROM (SELECT * FROM daily QUALIFY row_number() OVER
                      (PARTITION BY ticker ORDER BY date DESC) <= 5) GROUP BY ticker)"""


FLOW_CANDLES = f"""
fc AS (SELECT ticker, CAST("timestamp" AS DATE) AS date,
         {candle_sql('i_buy_per_capita', prefix='b_')},
         {candle_sql('i_sell_per_capita', prefix='s_')}
       FROM intraday GROUP BY ALL)"""
D1 = """b_close > 1.3*b_open AND s_open > 1.2*s_close
        AND b_close - b_open > 2*(b_high - b_close) AND s_open - s_close > 2*(s_close - s_low)"""


RANK = "row_number() OVER (ORDER BY buy_power, ticker) AS rank"


def screen_sql(stage_cte: str, confirm: str | None = None, unlocked: bool = False,
               hits_cond: str = "hits >= 3") -> str:
    if confirm is None:
        return with_(SNAP, CUR, stage_cte) + f"\nSELECT *, {RANK} FROM stage"
    if confirm == "persistence":
        return (with_(SNAP, CUR, DAILY, stage_cte, persistence_cte(unlocked))
                + f"\nSELECT stage.*, hits, {RANK} FROM stage JOIN hits USING (ticker)"
                + f" WHERE {hits_cond}")
    latest = """lfc AS (SELECT * FROM fc QUALIFY row_number() OVER
                (PARTITION BY ticker ORDER BY date DESC) = 1)"""
    return (with_(SNAP, CUR, INTRADAY, FLOW_CANDLES, latest, stage_cte)
            + f"\nSELECT *, {RANK} FROM stage WHERE ticker IN (SELECT ticker FROM lfc WHERE {D1})")


UNI_COLS = "ticker, download, trade_type, market, time, open"

def stacked(keys: str, src: str, values: list[str], latest: int) -> tuple[str, str]:
    aggs = ",\n".join(candle_sql(v, prefix=f"{v}_") for v in values)
    w = f"""w AS (SELECT * FROM (SELECT {keys}, CAST("timestamp" AS DATE) AS date, {aggs}
                  FROM {src} GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY date DESC) <= {latest})"""
    parts = [f"""SELECT {keys}, '{v}' AS indicator, date,
                 CAST({v}_high AS DOUBLE) AS high, CAST({v}_low AS DOUBLE) AS low,
                 CAST({v}_open AS DOUBLE) AS open, CAST({v}_close AS DOUBLE) AS close
                 FROM w WHERE {v}_open IS NOT NULL""" for v in values]
    return w, "\nUNION ALL\n".join(parts)


def _stacked_stock():
    w, body = stacked("ticker", "intraday", ["i_buy_per_capita", "i_sell_per_capita"], 60)
    return (with_(SNAP, INTRADAY, DAILY, w, f"st AS ({body})")
            + "\nSELECT st.*, daily.volume FROM st JOIN daily USING (ticker, date)")


def _market_candles():
    w, body = stacked("universe", "idx", ["i_buy_pow", "i_buy_per_capita", "i_sell_per_capita"], 60)
    return with_(SNAP, HOURLY, INDEX, w) + "\n" + body


JALALI = """
od AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders),
jd0 AS (SELECT *, CAST(o_orderdate - DATE '1970-01-01' AS BIGINT) + 719528 + 355667 AS dd FROM od),
jd1 AS (SELECT *, dd // 12053 AS k, dd % 12053 AS r FROM jd0),
jd2 AS (SELECT *, r // 1461 AS q, r % 1461 AS s0 FROM jd1),
jd3 AS (SELECT *, -1595 + 33*k + 4*q + CASE WHEN s0 > 365 THEN (s0 - 1) // 365 ELSE 0 END AS jy,
               CASE WHEN s0 > 365 THEN (s0 - 1) % 365 ELSE s0 END AS s FROM jd2),
jal AS (SELECT o_orderkey, o_orderdate, CAST(jy AS INTEGER) AS j_year,
               CAST(CASE WHEN s < 186 THEN 1 + s // 31 ELSE 7 + (s - 186) // 30 END AS INTEGER) AS j_month,
               CAST(CASE WHEN s < 186 THEN 1 + s % 31 ELSE 1 + (s - 186) % 30 END AS INTEGER) AS j_day
        FROM jd3),
jtxt AS (SELECT *, lpad(CAST(j_year AS VARCHAR), 4, '0') || '-' || lpad(CAST(j_month AS VARCHAR), 2, '0')
                   || '-' || lpad(CAST(j_day AS VARCHAR), 2, '0') AS j_text FROM jal)"""

# Jalali text → Gregorian date, independent of the forward formula: split
# the text and count days with the 33-year rule.
JALALI_BACK = """
jp AS (SELECT o_orderkey, o_orderdate, j_text,
              CAST(split_part(j_text, '-', 1) AS BIGINT) AS py,
              CAST(split_part(j_text, '-', 2) AS BIGINT) AS pm,
              CAST(split_part(j_text, '-', 3) AS BIGINT) AS pd FROM jtxt),
jb AS (SELECT *, py + 1595 AS yy FROM jp),
jg AS (SELECT o_orderkey, j_text, o_orderdate,
              CAST(DATE '1970-01-01' + CAST(-355668 + 365*yy + 8*(yy // 33) + ((yy % 33) + 3) // 4 + pd
                + CASE WHEN pm < 7 THEN 31*(pm - 1) ELSE 30*(pm - 7) + 186 END - 719528 AS INTEGER)
                AS DATE) AS g_date
       FROM jb)"""


def _hist_split():
    return daily_cte("stored", "ssnap") + "," + daily_cte("batch", "snap")


SINK_BASE = with_(SNAP, f"ssnap AS (SELECT * FROM snap WHERE {F3})", _hist_split())

GEOMETRY = """
SELECT *, close >= open AS up, open AS body_bottom, close - open AS body_height,
       CASE WHEN close >= open THEN close ELSE open END AS upper_bottom,
       CASE WHEN close >= open THEN high - close ELSE high - open END AS upper_height,
       CASE WHEN close >= open THEN open ELSE close END AS lower_bottom,
       CASE WHEN close >= open THEN low - open ELSE low - close END AS lower_height
FROM p"""

ORACLE: dict[str, str] = {
    "buy_power": with_(SNAP) + f"\nSELECT ticker, download, {M1} AS buy_power FROM snap",
    "per_capita": with_(SNAP) + f"\nSELECT ticker, download, {M2} AS buy_per_capita, "
                                f"{M3} AS sell_per_capita FROM snap",
    "entered_money": with_(SNAP) + f"\nSELECT ticker, download, {M4} AS entered_money FROM snap",
    "flow_ratios": with_(SNAP) + f"\nSELECT ticker, download, {M5} AS buy_ratio, "
                                 f"{M6} AS sell_ratio FROM snap",
    "tradable_universe": with_(SNAP) + f"\nSELECT {UNI_COLS} FROM snap WHERE {F1}",
    "tradable_no_base": with_(SNAP) + f"\nSELECT {UNI_COLS} FROM snap WHERE {F2}",
    "in_session": with_(SNAP) + f"\nSELECT {UNI_COLS} FROM snap WHERE {F3}",
    "has_opened": with_(SNAP) + f"\nSELECT {UNI_COLS} FROM snap WHERE NOT coalesce(open = 0, false)",
    "exclude_tickers": with_(SNAP) + f"\nSELECT {UNI_COLS} FROM snap WHERE ticker NOT IN "
                       "(SELECT 'S' || CAST(user_id AS VARCHAR) FROM events WHERE user_id % 5 = 0)",
    "large_caps": with_(SNAP) + f"\nSELECT {UNI_COLS} FROM snap WHERE ticker IN "
                  "(SELECT 'S' || CAST(user_id AS VARCHAR) FROM events WHERE user_id % 5 = 1)",
    "daily_flow": with_(SNAP, DAILY) + "\nSELECT * FROM daily",
    "average_volume": with_(LONG) + "\nSELECT ticker, date, volume, average_volume FROM longd",
    "intraday_flow": with_(SNAP, INTRADAY) + "\nSELECT * FROM intraday",
    "market_flow": with_(SNAP, HOURLY) + index_select("market", MARKET_WHERE),
    "large_flow": with_(SNAP, HOURLY) + index_select("large", LARGE_WHERE),
    **{f"candles_{n}": with_(SNAP, INTRADAY, candles_cte("c", "intraday", v))
       + "\nSELECT * FROM c WHERE open IS NOT NULL"
       for n, v in (("buy_power", "i_buy_pow"), ("buy_per_capita", "i_buy_per_capita"),
                    ("sell_per_capita", "i_sell_per_capita"))},
    "latest_sessions": with_(SNAP, DAILY) + "\nSELECT * FROM daily QUALIFY row_number() OVER "
                       "(PARTITION BY ticker ORDER BY date DESC) <= 5",
    "persistence": with_(SNAP, DAILY, persistence_cte(False)) + "\nSELECT * FROM hits",
    "persistence_unlocked": with_(SNAP, DAILY, persistence_cte(True)) + "\nSELECT * FROM hits",
    "volatile_limit_up": screen_sql(stage(F1, "1.5", "25", "5", None, "open", True)),
    "smart_money_short": screen_sql(stage(F1, "1.5", "15", "5", None, "open", False)),
    "smart_money_off_limit": screen_sql(stage(F2, "1.2", "20", "10", "40", "low", False),
                                        "persistence"),
    "smart_money_at_limit": screen_sql(stage(F2, "1.5", "20", "10", "50", "low", True),
                                       "persistence"),
    "divergence_at_limit": screen_sql(stage(F1, "1", "15", "5", None, "low", True), "divergence"),
    "divergence_off_limit": screen_sql(stage(F1, "1", "15", "5", None, "low", False), "divergence"),
    "candle_candidates": screen_sql(stage(F1, "1.5", "15", "10", None, "low", False),
                                    "persistence", unlocked=True, hits_cond="hits > 3"),
    "divergence_history": with_(SNAP, INTRADAY, FLOW_CANDLES) + f"\nSELECT * FROM fc WHERE {D1}",
    "screened_candles": with_(
        SNAP, CUR, INTRADAY, DAILY, stage(F1, "1.5", "15", "10", None, "low", False),
        persistence_cte(True), "surv AS (SELECT ticker FROM stage JOIN hits USING (ticker) "
                               "WHERE hits > 3)",
        candles_cte("c", "intraday", "i_buy_pow", latest=60))
        + "\nSELECT c.*, daily.volume FROM c JOIN daily USING (ticker, date) "
          "WHERE c.open IS NOT NULL AND ticker IN (SELECT ticker FROM surv)",
    "stock_buy_power_candles": with_(SNAP, INTRADAY, DAILY,
                                     candles_cte("c", "intraday", "i_buy_pow", latest=60))
        + "\nSELECT c.*, daily.i_entered_money FROM c JOIN daily USING (ticker, date) "
          "WHERE c.open IS NOT NULL",
    "stock_price_candles": with_(LONG) + "\nSELECT ticker, date, high, low, open, last AS close, "
        "volume FROM longd QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 59",
    "stock_per_capita_candles": _stacked_stock(),
    "stock_last_session": with_(SNAP, INTRADAY) + """
SELECT ticker, "timestamp", date_trunc('minute', "timestamp") AS minute, last_percent, i_buy_pow,
       i_buy_per_capita, i_sell_per_capita, i_entered_money FROM intraday
SEMI JOIN (SELECT ticker, max(CAST("timestamp" AS DATE)) AS d FROM intraday GROUP BY ticker) m
  ON intraday.ticker = m.ticker AND CAST(intraday."timestamp" AS DATE) = m.d""",
    "stock_valuation": with_(LONG) + """
SELECT ticker, date, eps,
       CAST(CAST(last AS REAL) AS DOUBLE) / NULLIF(eps, 0) AS pe,
       CAST(volume AS DOUBLE) * CAST(CAST(close AS REAL) AS DOUBLE) / 10000000000 AS trade_value,
       CAST(average_volume AS DOUBLE) * CAST(CAST(close AS REAL) AS DOUBLE) / 10000000000
         AS avg_trade_value
FROM longd QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""",
    "market_candles": _market_candles(),
    "market_last_session": with_(SNAP, HOURLY, INDEX) + """
SELECT universe, "timestamp", date_trunc('minute', "timestamp") AS minute, i_buy_pow,
       i_buy_per_capita, i_sell_per_capita, i_entered_money FROM idx
SEMI JOIN (SELECT universe, max(CAST("timestamp" AS DATE)) AS d FROM idx GROUP BY universe) m
  ON idx.universe = m.universe AND CAST(idx."timestamp" AS DATE) = m.d""",
    "candle_geometry": with_(LONG, """p AS (SELECT ticker, date, high, low, open, last AS close,
        volume FROM longd QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 59)""")
        + GEOMETRY,
    "jalali_from_date": with_(JALALI) + "\nSELECT o_orderkey, o_orderdate, j_year, j_month, "
                                        "j_day, j_text FROM jtxt",
    "date_from_jalali": with_(JALALI, JALALI_BACK) + "\nSELECT o_orderkey, j_text, g_date, "
                                                     "g_date = o_orderdate AS round_trip FROM jg",
    "append_unique_skip": SINK_BASE + """
SELECT * FROM stored
UNION ALL SELECT batch.* FROM batch ANTI JOIN stored USING (ticker, date)""",
    "append_unique_replace": SINK_BASE + """
SELECT stored.* FROM stored ANTI JOIN batch USING (ticker, date)
UNION ALL SELECT * FROM batch""",
    "schema_evolution": with_(SNAP, INTRADAY, """cut AS (SELECT min(CAST("timestamp" AS DATE))
        + CAST(floor(datediff('day', min(CAST("timestamp" AS DATE)), max(CAST("timestamp" AS DATE))) / 2)
          AS INTEGER) AS m FROM intraday)""") + """
SELECT * REPLACE (CASE WHEN CAST("timestamp" AS DATE) < (SELECT m FROM cut) THEN NULL
                       ELSE last_percent END AS last_percent,
                  CASE WHEN CAST("timestamp" AS DATE) < (SELECT m FROM cut) THEN NULL
                       ELSE volume END AS volume)
FROM intraday""",
    "stream_dedup": with_(SNAP, INTRADAY) + "\nSELECT * FROM intraday",
    "stream_candles": with_(SNAP, INTRADAY, candles_cte("c", "intraday", "i_buy_pow")) + """
SELECT * FROM c WHERE open IS NOT NULL""",
}

def gaps_sql(ctes: list[str], src: str, key: str) -> str:
    """Days inside each key's span without a row of ``src``, with Jalali fields."""
    jal = JALALI.replace("FROM orders", "FROM gaps").replace(
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate",
        f"SELECT {key} AS o_orderkey, date AS o_orderdate")
    return with_(*ctes, f"""span AS (SELECT {key}, min(date) AS lo, max(date) AS hi
    FROM {src} GROUP BY {key})""", f"""days AS (SELECT {key}, CAST(unnest(generate_series(lo, hi,
    INTERVAL 1 DAY)) AS DATE) AS date FROM span)""", f"""gaps AS (SELECT days.* FROM days
    ANTI JOIN {src} USING ({key}, date))""", jal) + f"""
SELECT o_orderkey AS {key}, o_orderdate AS date, j_year, j_month, j_day FROM jal"""


ORACLE["calendar_gaps"] = gaps_sql([LONG], "longd", "ticker")
ORACLE["buy_power_gaps"] = gaps_sql([f"bc AS ({ORACLE['candles_buy_power']})"], "bc", "ticker")
ORACLE["market_gaps"] = gaps_sql([f"mc AS ({ORACLE['market_candles']})"], "mc", "universe")
ORACLE["screened_price_geometry"] = with_(
    SNAP, DAILY, f"surv AS (SELECT ticker FROM ({ORACLE['candle_candidates']}))",
    """p AS (SELECT ticker, date, high, low, open, last AS close, volume
        FROM daily SEMI JOIN surv USING (ticker)
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 59)""") + GEOMETRY

FSNAP = f"fsnap AS (SELECT * FROM snap WHERE {F1} AND {F3} AND NOT coalesce(open = 0, false))"
ORACLE["daily_load"] = with_(SNAP, FSNAP, daily_cte("dl", "fsnap")) + "\nSELECT * FROM dl"
ORACLE["intraday_load"] = (with_(SNAP, f"isnap AS (SELECT * FROM snap WHERE {F1} AND {F3})",
                                 INTRADAY.replace("FROM snap)", "FROM isnap)"))
                           + "\nSELECT * FROM intraday")
ORACLE["market_load"] = with_(SNAP, HOURLY, INDEX) + "\nSELECT * FROM idx"
ORACLE["sessions"] = with_(SNAP, INTRADAY) + \
    '\nSELECT DISTINCT ticker, CAST("timestamp" AS DATE) AS date FROM intraday'
ORACLE["stream_market_flow"] = ORACLE["market_load"]
ORACLE["stream_screen"] = ORACLE["smart_money_off_limit"]
ORACLE["stream_candles_live"] = ORACLE["candles_buy_power"]

# All seven screens in one result: each screen's own SQL, tagged and unioned.
_PERSIST = ("smart_money_off_limit", "smart_money_at_limit", "candle_candidates")
ORACLE["all_screens"] = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS screen, ticker, buy_power, buy_per_capita, sell_per_capita,
       {'hits' if name in _PERSIST else 'CAST(NULL AS BIGINT)'} AS hits, rank
FROM ({ORACLE[name]})"""
    for name in ("volatile_limit_up", "smart_money_short", "smart_money_off_limit",
                 "smart_money_at_limit", "divergence_at_limit", "divergence_off_limit",
                 "candle_candidates"))

ORACLE["stream_all_screens"] = ORACLE["all_screens"]
ORACLE["stream_screen_divergence"] = ORACLE["divergence_off_limit"]

# Stored tables equal what one pass over all captures gives.
ORACLE["ingest_atomic"] = ORACLE["daily_load"]
ORACLE["follow_ingest"] = ORACLE["intraday_load"]
ORACLE["stream_market_flow_repeated"] = ORACLE["market_load"]
ORACLE["rollup_sessions"] = ORACLE["sessions"]
for _name in ("divergence_history", "divergence_at_limit", "divergence_off_limit",
              "market_candles", "screened_candles"):
    ORACLE[f"rollup_{_name}"] = ORACLE[_name]
for _name in ("buy_power_candles", "per_capita_candles"):
    ORACLE[f"rollup_{_name}"] = ORACLE[f"stock_{_name}"]


def cut_sql(src: str, day: str) -> str:
    """The middle session date of ``src``."""
    return f"""cut AS (SELECT min({day}) + CAST(floor(datediff('day', min({day}), max({day})) / 2)
              AS INTEGER) AS m FROM {src})"""


ORACLE["raw_text_load"] = with_(SNAP) + """
SELECT ticker, market, time, CASE WHEN volume % 97 <> 0 THEN download END AS download,
       CASE WHEN volume % 89 <> 1 THEN open END AS open, close, close_percent, volume, eps,
       volume % 97 <> 0 AND volume % 89 <> 1 AS usable,
       concat_ws(';', CASE WHEN volume % 97 = 0 THEN 'download=1400-12-30 10:00:00' END,
                 CASE WHEN volume % 89 = 1 THEN 'open=n/a' END) AS bad_text
FROM snap"""
ORACLE["jalali_minute"] = with_(SNAP) + """
SELECT ticker, download, date_trunc('minute', download) AS minute FROM snap"""
ORACLE["append_unique_error"] = ORACLE["daily_flow"]
ORACLE["append_unique_intraday"] = with_(SNAP, INTRADAY) + """
SELECT * REPLACE (CASE WHEN volume % 2 = 0 THEN -volume ELSE volume END AS volume) FROM intraday"""
ORACLE["append_by_key_filters"] = ORACLE["append_unique_intraday"]
ORACLE["append_unique_index"] = with_(SNAP, HOURLY, INDEX) + """
SELECT * REPLACE (CASE WHEN hour("timestamp") >= 12 THEN -1 ELSE i_entered_money END
                  AS i_entered_money) FROM idx"""
ORACLE["daily_load_incremental"] = with_(
    SNAP, FSNAP, daily_cte("dl", "fsnap"), cut_sql("snap", "CAST(download AS DATE)")) + """
SELECT * FROM dl WHERE date >= (SELECT m FROM cut)"""
ORACLE["daily_load_blocks"] = ORACLE["daily_load_incremental"]
ORACLE["daily_load_late"] = ORACLE["daily_load"]
ORACLE["screen_latest_capture"] = with_(SNAP, """dsnap AS (SELECT * FROM snap QUALIFY row_number()
    OVER (PARTITION BY ticker, CAST(download AS DATE) ORDER BY download DESC) = 1)""",
    """cur AS (SELECT * FROM dsnap WHERE CAST(download AS DATE) =
    (SELECT max(CAST(download AS DATE)) FROM dsnap))""",
    stage(F1, "1.5", "15", "5", None, "open", False)) + f"\nSELECT *, {RANK} FROM stage"
ORACLE["watchlist_per_capita_candles"] = f"""
SELECT * FROM ({ORACLE['stock_per_capita_candles']}) WHERE ticker IN
(SELECT 'S' || CAST(user_id AS VARCHAR) FROM events WHERE user_id % 5 = 1)"""
ORACLE["valuation_display"] = f"""
SELECT v.*, round_even(pe, 2) AS pe_display, round_even(trade_value, 2) AS trade_value_display,
       round_even(avg_trade_value, 2) AS avg_trade_value_display, market_cap
FROM ({ORACLE['stock_valuation']}) v JOIN ({with_(LONG)}
SELECT ticker, CAST(round_even(CAST(volume AS DOUBLE) * close * 1000 / 10000000000, 0) AS BIGINT)
       AS market_cap
FROM longd QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) c
USING (ticker)"""
ORACLE["calendar_gap_runs"] = with_(LONG) + """
SELECT ticker, CAST(date + INTERVAL 1 DAY AS DATE) AS gap_from,
       CAST(next - INTERVAL 1 DAY AS DATE) AS gap_to
FROM (SELECT ticker, date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS next FROM longd)
WHERE datediff('day', date, next) > 1"""
