"""Catalog: bar store operators (slices, reshapes, calendar, as-of, returns)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import targets as TG
from ..operators.util import frames_df
from ..sources import fixtures as FX
from . import oracle_sql as S
from .catalog import query, r6

METRICS = ("open", "high", "low", "close", "adj_close", "volume")
# Fixed values of the fixtures: the event types that act as tickers.
EVENT_TICKERS = ("view", "signup", "click", "error", "purchase")
SLICE_TICKERS = ("Brand#12", "Brand#3", "Brand#21")


def _bar_cols(df, prefix=()):
    return df.select(*prefix, "date", "ticker", *[r6(m).alias(m) for m in METRICS if m in df.columns])


def _sql_bar_cols(src="b", extra=""):
    cols = ", ".join(f"round({src}.{m}, 6) AS {m}" for m in METRICS)
    return f"{extra}{src}.date, {src}.ticker, {cols}"


_TICK_SQL = ", ".join(f"'{t}'" for t in SLICE_TICKERS)


@query("price_slice", S.with_(b=S.BRAND_BARS) + f"""
SELECT {_sql_bar_cols()} FROM b
WHERE b.date BETWEEN DATE '1995-03-01' AND DATE '1996-02-29' AND b.ticker IN ({_TICK_SQL})""")
def price_slice(spark, sf):
    bars = FX.brand_bars(spark, sf)
    return _bar_cols(B.price_slice(bars, "1995-03-01", "1996-02-29", list(SLICE_TICKERS)))


@query("price_scan", S.with_(b=S.BRAND_BARS) + f"""
SELECT {_sql_bar_cols()} FROM b
WHERE b.date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND b.ticker IN ({_TICK_SQL})""")
def price_scan(spark, sf):
    bars = FX.brand_bars(spark, sf)
    return _bar_cols(B.price_scan(bars, list(SLICE_TICKERS), "1996-01-01", "1997-12-31"))


_UNPIVOT_SQL = " UNION ALL ".join(
    f"SELECT date, '{m}' AS metric, ticker, round({m}, 6) AS value FROM b" for m in METRICS)


@query("price_unpivot", S.with_(b=S.EVENT_BARS) + _UNPIVOT_SQL)
def price_unpivot(spark, sf):
    wide = B.price_pivot_wide(FX.event_bars(spark, sf), EVENT_TICKERS)
    long = B.price_unpivot(wide)
    return long.select("date", "metric", "ticker", r6("value").alias("value"))


# The reference store's metric names before normalisation.
STORE_METRIC_NAMES = {"open": "Open", "high": "High", "low": "Low", "close": "Close",
                      "adj_close": "Adj Close", "volume": "Volume"}


@query("price_pivot_bars", S.with_(b=S.EVENT_BARS) + f"SELECT {_sql_bar_cols()} FROM b")
def price_pivot_bars(spark, sf):
    bars = FX.event_bars(spark, sf)
    long = bars.unpivot(["date", "ticker"], list(METRICS), "metric", "value") \
               .replace(STORE_METRIC_NAMES, subset=["metric"])
    return _bar_cols(B.price_pivot_bars(long))


_CAL_SQL = """bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM b),
grid AS (SELECT t.ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT ticker FROM b) t, bounds),
p AS (SELECT g.date, g.ticker, b.open, b.high, b.low, b.close, b.adj_close, b.volume
      FROM grid g LEFT JOIN b ON b.date = g.date AND b.ticker = g.ticker)"""


@query("calendar_fill", S.with_(b=S.BRAND_BARS)[:-1] + ",\n" + _CAL_SQL + f"\nSELECT {_sql_bar_cols('p')} FROM p")
def calendar_fill(spark, sf):
    return _bar_cols(B.calendar_fill(FX.staged(FX.brand_bars(spark, sf), "brand_bars")))


@query("drop_incomplete_bars", S.with_(b=S.BRAND_BARS) + f"SELECT {_sql_bar_cols()} FROM b")
def drop_incomplete_bars(spark, sf):
    return _bar_cols(B.drop_incomplete_bars(B.calendar_fill(FX.brand_bars(spark, sf))))


@query("weekend_ffill", S.with_(b=S.BRAND_BARS) + """,
sl AS (SELECT * FROM b WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'),
days AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
m AS (SELECT day, (SELECT max(date) FROM sl WHERE sl.date <= days.day) AS mday FROM days)
SELECT m.day AS date, sl.ticker, """.replace("\n,", ",") + ", ".join(
    f"round(sl.{c}, 6) AS {c}" for c in METRICS) + " FROM m JOIN sl ON sl.date = m.mday")
def weekend_ffill(spark, sf):
    return _bar_cols(B.weekend_ffill(FX.brand_bars(spark, sf), "1995-01-01", "1995-12-31"))


_REQ_SQL = "SELECT account, symbol AS ticker, date + CAST(account AS INTEGER) AS date, side, shares FROM t"


@query("price_asof", S.with_(b=S.BRAND_BARS, t=S.TRADES) + f""",
r AS ({_REQ_SQL})
SELECT r.account, r.ticker, r.date, r.side, r.shares, round(b.close, 6) AS price
FROM r ASOF LEFT JOIN b ON r.ticker = b.ticker AND r.date >= b.date""".replace("\n,", ","))
def price_asof(spark, sf):
    t = FX.trades(spark, sf)
    req = t.select("account", F.col("symbol").alias("ticker"),
                   F.date_add("date", F.col("account").cast("int")).alias("date"), "side", "shares")
    out = B.price_asof(FX.brand_bars(spark, sf), req, "close")
    return out.select("account", "ticker", "date", "side", "shares", r6("price").alias("price"))


@query("available_prices", S.with_(b=S.BRAND_BARS, t=S.TRADES) + """,
d AS (SELECT DISTINCT date + 1 AS day FROM t),
m AS (SELECT day, (SELECT max(date) FROM b WHERE b.date <= d.day) AS mday FROM d)
SELECT m.day AS date, b.ticker, round(b.open, 6) AS price FROM m LEFT JOIN b ON b.date = m.mday""".replace("\n,", ","))
def available_prices(spark, sf):
    dates = FX.trades(spark, sf).select(F.date_add("date", 1).alias("date"))
    out = B.available_prices(FX.brand_bars(spark, sf), dates, at="open", trading_on_weekend=True)
    return out.select("date", "ticker", r6("price").alias("price"))


_GROWTH_DAILY = "(pow(1.1, 1.0 / 252) - 1)"


@query("growth_series", S.with_(b=S.BRAND_BARS) + f""",
d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM b),
bd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM d WHERE isodow(date) <= 5)
SELECT date, 'YEARLY_10_PERCENT' AS ticker, """.replace("\n,", ",") + ", ".join(
    f"round(pow(1 + {_GROWTH_DAILY}, i), 6) AS {c}" for c in ("open", "high", "low", "close", "adj_close"))
    + " FROM bd")
def growth_series(spark, sf):
    bars = FX.brand_bars(spark, sf)
    return _bar_cols(B.growth_series_for(bars))


@query("price_catalog", S.with_(b=S.BRAND_BARS) + """
SELECT min(date) AS min_date, max(date) AS max_date,
  string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers, count(*) AS n_rows,
  'open,high,low,close,adj_close,volume' AS metrics FROM b""")
def price_catalog(spark, sf):
    return B.price_catalog(FX.brand_bars(spark, sf))


_VOL_TICKERS = ("Brand#11", "Brand#12", "Brand#13")


@query("volume_series", S.with_(b=S.BRAND_BARS) + """
SELECT date, ticker, round(volume, 6) AS volume FROM b WHERE ticker IN ('Brand#11', 'Brand#12', 'Brand#13')""")
def volume_series(spark, sf):
    b = B.price_slice(FX.brand_bars(spark, sf), "1900-01-01", "2100-01-01", list(_VOL_TICKERS))
    return b.select("date", "ticker", r6("volume").alias("volume"))


_NULLS_SQL = " + ".join(f"CASE WHEN {m} IS NULL THEN 1 ELSE 0 END" for m in METRICS)


@query("weekly_availability", S.with_(b=S.BRAND_BARS) + f""",
days AS (SELECT DISTINCT date FROM b),
wk AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, count(*) AS n_days FROM days GROUP BY 1),
bounds AS (SELECT min(week_end) AS lo, max(week_end) AS hi FROM wk),
grid AS (SELECT t.ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_end
         FROM (SELECT DISTINCT ticker FROM b) t, bounds),
pres AS (SELECT ticker, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, count(*) AS present,
         sum({_NULLS_SQL}) AS nm FROM b GROUP BY 1, 2)
SELECT g.ticker, g.week_end,
  round(1 - (coalesce(p.nm, 0) + 6 * (wk.n_days - coalesce(p.present, 0))) / CAST(wk.n_days * 6 AS DOUBLE), 6) AS availability
FROM grid g LEFT JOIN wk ON wk.week_end = g.week_end
LEFT JOIN pres p ON p.ticker = g.ticker AND p.week_end = g.week_end""".replace("\n,", ","))
def weekly_availability(spark, sf):
    from ..operators.profiling import weekly_availability as wa
    return wa(FX.staged(FX.brand_bars(spark, sf), "brand_bars")).select("ticker", "week_end", r6("availability").alias("availability"))


N_DAYS = (1, 2, 6, 7, 8, 10, 20, 30)

_GRID_SQL = """grid AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM b) t, (SELECT DISTINCT date FROM b) d),
g AS (SELECT grid.ticker, grid.date, b.open, b.adj_close FROM grid LEFT JOIN b USING (ticker, date)),
pd AS (SELECT ticker, date, open, adj_close, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS padded FROM g)"""


def _nday_sql(n):
    return (f"SELECT ticker, {n} AS n, date, round(ret, 6) AS ret FROM (SELECT ticker, date, "
            f"padded / NULLIF(lag(padded, {n}) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM pd) "
            "WHERE ret IS NOT NULL")


@query("n_day_return", S.with_(b=S.BRAND_BARS)[:-1] + ",\n" + _GRID_SQL + "\n"
       + " UNION ALL ".join(_nday_sql(n) for n in N_DAYS))
def n_day_return(spark, sf):
    grid = B.market_grid(FX.staged(FX.brand_bars(spark, sf), "brand_bars"))
    return B.n_day_returns(grid, N_DAYS).select("ticker", "n", "date", r6("ret").alias("ret"))


@query("overnight_return", S.with_(b=S.BRAND_BARS)[:-1] + ",\n" + _GRID_SQL + """
SELECT ticker, date, round(ret, 6) AS ret FROM (SELECT ticker, date,
  lead(open) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(adj_close, 0) - 1 AS ret FROM pd)
WHERE ret IS NOT NULL""")
def overnight_return(spark, sf):
    grid = B.market_grid(FX.staged(FX.brand_bars(spark, sf), "brand_bars"))
    return B.overnight_return(grid).select("ticker", "date", r6("ret").alias("ret"))


@query("weekend_flag", S.with_(t=S.TRADES) + """
SELECT account, date, symbol, side, shares, isodow(date) >= 6 AS is_weekend FROM t""")
def weekend_flag(spark, sf):
    from ..functions.columns import is_weekend
    t = FX.trades(spark, sf)
    return t.select("account", "date", "symbol", "side", "shares", is_weekend("date").alias("is_weekend"))


@query("input_checks", S.with_(b=S.BRAND_BARS, t=S.TRADES) + """,
st AS (SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM b GROUP BY ticker),
asked AS (SELECT DISTINCT symbol AS ticker FROM t)
SELECT a.ticker, st.ticker IS NOT NULL AS is_known, st.first_date, st.last_date
FROM asked a LEFT JOIN st ON st.ticker = a.ticker""".replace("\n,", ","))
def input_checks(spark, sf):
    from ..operators.quality import ticker_checks
    store = FX.brand_bars(spark, sf)
    asked = FX.trades(spark, sf).select(F.col("symbol").alias("ticker")).distinct()
    return ticker_checks(asked, store)


@query("input_range_checks", S.with_(b=S.BRAND_BARS) + """,
st AS (SELECT min(date) AS first_date, max(date) AS last_date FROM b),
asked AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3001 AS INTEGER) AS start,
            CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4001 AS INTEGER) - 300 AS "end" FROM orders)
SELECT request_id, start, "end", first_date, last_date, start <= "end" AS is_forwards,
  "end" >= first_date AND start <= last_date AS overlaps_store,
  start <= "end" AND "end" >= first_date AND start <= last_date AS is_answerable FROM asked, st""".replace("\n,", ","))
def input_range_checks(spark, sf):
    from ..operators.quality import range_checks
    o, day = FX.table(spark, sf, "orders"), F.col("o_orderdate").cast("date")
    asked = o.select(F.col("o_orderkey").alias("request_id"), F.date_add(day, (F.col("o_orderkey") % 3001).cast("int")).alias("start"),
                     F.date_add(day, (F.col("o_orderkey") % 4001 - 300).cast("int")).alias("end"))
    return range_checks(asked, FX.brand_bars(spark, sf))


@query("time_frame_split", S.with_(b=S.EVENT_BARS, f=S.frames_values(
    (("train", "2024-01-01", "2024-01-30"), ("val", "2024-01-01", "2024-01-30"),
     ("test", "2024-01-01", "2024-01-30")))) + f"""
SELECT f.split, {_sql_bar_cols()} FROM b JOIN f ON b.date BETWEEN f.fstart AND f.fend""")
def time_frame_split(spark, sf):
    fr = frames_df(spark, FX.EVENT_FRAMES)
    return _bar_cols(TG.time_frame_split(FX.event_bars(spark, sf), fr), prefix=("split",))


@query("train_tail_frame", S.with_(b=S.BRAND_BARS) + f"""
SELECT {_sql_bar_cols()} FROM b
WHERE b.date BETWEEN greatest(DATE '1999-12-31' - CAST(DATE '2001-12-31' - DATE '2001-01-01' AS INTEGER), DATE '1995-01-01')
  AND DATE '1999-12-31'""")
def train_tail_frame(spark, sf):
    fr = frames_df(spark, FX.BRAND_FRAMES)
    tail = TG.train_tail_frame(fr)
    bars = FX.brand_bars(spark, sf)
    rows = bars.join(F.broadcast(tail), bars.date.between(tail.start, tail.end)).drop("start", "end")
    return _bar_cols(rows)
