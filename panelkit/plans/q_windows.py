"""Catalog: sliding windows, returns, masking, scaling, feature lists, news joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import weekday_name
from ..operators import bars as B
from ..operators import news as N
from ..operators import windows as WN
from ..params import Params
from ..sources import fixtures as FX
from ..sources import stores as ST
from . import oracle_sql as S
from .catalog import query, r6

L, H = 5, 1
FEATS = ("open", "high", "low", "close", "adj_close", "volume")
MASKED = ("close", "adj_close", "high", "low", "volume")


def panel(spark, sf):
    """The calendar panel as it is stored: bucketed by ticker, so that windows are
    cut, checked and gathered where their ticker lies."""
    return ST.panel_table(B.calendar_fill(FX.staged(FX.brand_bars(spark, sf), "brand_bars")))


def windows(spark, sf, lookback=L, horizon=H, aggregation="last", selling_at="open"):
    return WN.sliding_windows(panel(spark, sf), lookback, horizon, aggregation, selling_at)


def _panel_sql(w: int) -> str:
    """CTEs: b (bars), bounds, grid, p (calendar panel with pos, n), lw (all windows)."""
    return S.with_(b=S.BRAND_BARS)[:-1] + f""",
bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM b),
grid AS (SELECT t.ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT ticker FROM b) t, bounds),
p AS MATERIALIZED (SELECT g.date, g.ticker, b.open, b.high, b.low, b.close, b.adj_close, b.volume,
        datediff('day', bo.lo, g.date) AS pos, datediff('day', bo.lo, bo.hi) + 1 AS n
      FROM grid g CROSS JOIN bounds bo LEFT JOIN b ON b.date = g.date AND b.ticker = g.ticker),
lw AS (SELECT * FROM (SELECT e.*, pos - day_idx AS sample_id FROM (SELECT p.*, unnest(range(0, {w})) AS day_idx FROM p) e)
       WHERE sample_id BETWEEN 0 AND n - {w})"""


def _windows_sql(lookback=L, horizon=H, aggregation="last", selling_at="open") -> str:
    """ok: the valid windows, found on the panel; sw: their days, by equal keys."""
    w = lookback + horizon
    if aggregation in ("first", "last"):
        at = str(lookback if aggregation == "first" else w - 1)
    else:
        at = f"unnest(range({lookback}, {w}))"
    return _panel_sql(w).rsplit("\nlw AS", 1)[0] + f"""
ok AS MATERIALIZED (SELECT DISTINCT ticker, sample_id FROM (SELECT ticker, n, pos - {at} AS sample_id FROM p WHERE {selling_at} IS NOT NULL)
       WHERE sample_id BETWEEN 0 AND n - {w}),
sw AS (SELECT p.*, k.sample_id, k.day_idx FROM (SELECT ticker, sample_id, unnest(range(0, {w})) AS day_idx FROM ok) k
       JOIN p ON p.ticker = k.ticker AND p.pos = k.sample_id + k.day_idx)"""


def _round_cols(cols, src=""):
    return ", ".join(f"round({src}{c}, 6) AS {c}" for c in cols)


@query("sliding_windows", _windows_sql() + f"""
SELECT ticker, sample_id, day_idx, date, {_round_cols(('open', 'close'))} FROM sw""")
def sliding_windows(spark, sf):
    return windows(spark, sf).select("ticker", WN.SAMPLE_ID, WN.DAY_IDX, "date", r6("open").alias("open"),
                                     r6("close").alias("close"))


@query("sliding_windows_frame", _panel_sql(L + H) + """
SELECT ticker, sample_id, min(date) AS start_date, round(arg_min_null(close, day_idx), 6) AS v_first,
  round(arg_max_null(close, day_idx), 6) AS v_last, round(sum(close), 6) AS v_sum,
  count(*) - count(close) AS n_null
FROM lw GROUP BY ticker, sample_id""")
def sliding_windows_frame(spark, sf):
    fr = WN.sliding_windows_frame(panel(spark, sf), L + H, "close")
    vals = F.col("values")
    s = F.aggregate(vals, F.lit(None).cast("double"),
                    lambda acc, v: F.when(v.isNull(), acc).otherwise(F.coalesce(acc, F.lit(0.0)) + v))
    return fr.select("ticker", WN.SAMPLE_ID, "start_date",
                     r6(F.element_at(vals, 1)).alias("v_first"), r6(F.element_at(vals, -1)).alias("v_last"),
                     r6(s).alias("v_sum"), F.size(F.filter(vals, lambda v: v.isNull())).cast("bigint").alias("n_null"))


@query("lookback_horizon_split", _windows_sql() + """
SELECT ticker, sample_id, day_idx, CASE WHEN day_idx < 5 THEN 'x' ELSE 'y' END AS part,
  round(open, 6) AS open FROM sw""")
def lookback_horizon_split(spark, sf):
    x, y = WN.lookback_horizon_split(windows(spark, sf), L)
    cols = ["ticker", WN.SAMPLE_ID, WN.DAY_IDX, r6("open").alias("open")]
    return x.select(*cols, F.lit("x").alias("part")).unionByName(y.select(*cols, F.lit("y").alias("part")))


_MASK_SQL = ", ".join(
    f"round(CASE WHEN day_idx = 4 THEN NULL ELSE {c} END, 6) AS {c}" if c in MASKED else f"round({c}, 6) AS {c}"
    for c in FEATS)


@query("mask_last_day", _windows_sql() + f"""
SELECT ticker, sample_id, day_idx, date, {_MASK_SQL} FROM sw""")
def mask_last_day(spark, sf):
    m = WN.mask_last_day(windows(spark, sf), L, MASKED)
    return m.select("ticker", WN.SAMPLE_ID, WN.DAY_IDX, "date", *[r6(c).alias(c) for c in FEATS])


@query("weekday_name", S.with_(b=S.BRAND_BARS) + "SELECT date, ticker, dayname(date) AS weekday FROM b")
def weekday_name_q(spark, sf):
    return FX.brand_bars(spark, sf).select("date", "ticker", weekday_name("date").alias("weekday"))


def _return_sql(aggregation="last", horizon=H, selling_at="open", buying_at="open"):
    sell = {"last": f"arg_max({selling_at}, day_idx)", "first": f"arg_min({selling_at}, day_idx)",
            "mean": f"avg({selling_at})", "max": f"max({selling_at})", "min": f"min({selling_at})"}[aggregation]
    return (_windows_sql(L, horizon, aggregation, selling_at) + f""",
ret AS (SELECT ticker, sample_id,
  arg_max({buying_at}, day_idx) FILTER (WHERE day_idx < {L} AND {buying_at} IS NOT NULL) AS buy,
  {sell} FILTER (WHERE day_idx >= {L} AND {selling_at} IS NOT NULL) AS sell
  FROM sw GROUP BY ticker, sample_id)""")


@query("forward_return", _return_sql() + """
SELECT ticker, sample_id, round(sell / NULLIF(buy, 0) - 1, 6) AS return FROM ret""")
def forward_return(spark, sf):
    r = WN.forward_return(windows(spark, sf), L, "open", "open", "last")
    return r.select("ticker", WN.SAMPLE_ID, r6("return").alias("return"))


@query("forward_return_h3_mean", _return_sql("mean", 3, "close", "open") + """
SELECT ticker, sample_id, round(sell / NULLIF(buy, 0) - 1, 6) AS return FROM ret""")
def forward_return_h3_mean(spark, sf):
    r = WN.forward_return(windows(spark, sf, L, 3, "mean", "close"), L, "open", "close", "mean")
    return r.select("ticker", WN.SAMPLE_ID, r6("return").alias("return"))


@query("horizon_target_agg", _return_sql("max", 3, "close") + """
SELECT ticker, sample_id, round(sell, 6) AS sell_value FROM ret""")
def horizon_target_agg(spark, sf):
    h = WN.horizon_target_agg(windows(spark, sf, L, 3, "max", "close"), L, "close", "max")
    return h.select("ticker", WN.SAMPLE_ID, r6("sell_value").alias("sell_value"))


def _scaling_sql(how: str) -> str:
    x = f"SELECT ticker, sample_id, day_idx, {_MASK_SQL.replace('round(', '(').replace(', 6)', ')')} FROM sw WHERE day_idx < {L}"
    frame = "OVER (PARTITION BY ticker, sample_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    ref = {"first": "first_value({c} IGNORE NULLS) " + frame, "last": "last_value({c} IGNORE NULLS) " + frame,
           "min": "min({c}) OVER (PARTITION BY ticker, sample_id)",
           "max": "max({c}) OVER (PARTITION BY ticker, sample_id)",
           "mean": "avg({c}) OVER (PARTITION BY ticker, sample_id)"}[how]
    cols = ", ".join(f"round({c} / NULLIF({ref.format(c=c)}, 0), 6) AS {c}" for c in FEATS)
    return _windows_sql() + f""",
x AS ({x})
SELECT ticker, sample_id, day_idx, {cols} FROM x"""


def _scaling_query(how):
    def run(spark, sf):
        x, _ = WN.lookback_horizon_split(windows(spark, sf), L)
        x = WN.mask_last_day(x, L, MASKED)
        s = WN.relative_scaling(x, FEATS, how)
        return s.select("ticker", WN.SAMPLE_ID, WN.DAY_IDX, *[r6(c).alias(c) for c in FEATS])
    run.__name__ = f"relative_scaling_{how}"
    return run


for _how in ("first", "last", "min", "max", "mean"):
    query(f"relative_scaling_{_how}", _scaling_sql(_how))(_scaling_query(_how))


_FRAME = "OVER (PARTITION BY ticker, sample_id ORDER BY day_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("relative_scaling_horizon", _windows_sql(L, 3) + f""",
m AS (SELECT ticker, sample_id, day_idx, {_MASK_SQL.replace('round(', '(').replace(', 6)', ')')} FROM sw)
SELECT ticker, sample_id, day_idx, CASE WHEN day_idx < {L} THEN 'x' ELSE 'y' END AS part,
  {", ".join(f"round({c} / NULLIF(first_value(CASE WHEN day_idx < {L} THEN {c} END IGNORE NULLS) {_FRAME}, 0), 6) AS {c}" for c in FEATS)}
FROM m""")
def relative_scaling_horizon(spark, sf):
    """Look-back and horizon scaled by the look-back's first values."""
    m = WN.mask_last_day(windows(spark, sf, L, 3), L, MASKED)
    s = WN.relative_scaling(m, FEATS, "first", lookback=L)
    x, y = WN.lookback_horizon_split(s, L)
    both = x.withColumn("part", F.lit("x")).unionByName(y.withColumn("part", F.lit("y")))
    return both.select("ticker", WN.SAMPLE_ID, WN.DAY_IDX, "part", *[r6(c).alias(c) for c in FEATS])


@query("window_feature_lists", _windows_sql() + f"""
SELECT ticker, sample_id, day_idx AS pos, date, round(open, 6) AS open, round(close, 6) AS close
FROM sw WHERE day_idx < {L}""")
def window_feature_lists(spark, sf):
    x, _ = WN.lookback_horizon_split(windows(spark, sf), L)
    lists = WN.window_feature_lists(x, ["date", "open", "close"])
    z = lists.select("ticker", WN.SAMPLE_ID, F.posexplode(F.arrays_zip("date", "open", "close")).alias("pos", "z"))
    return z.select("ticker", WN.SAMPLE_ID, "pos", "z.date", r6("z.open").alias("open"), r6("z.close").alias("close"))


@query("feature_target_join", _return_sql() + f""",
fl AS (SELECT ticker, sample_id, count(*) AS n_days, arg_min_null(open, day_idx) AS first_open
       FROM sw WHERE day_idx < {L} GROUP BY ticker, sample_id)
SELECT fl.ticker, fl.sample_id, fl.n_days, round(fl.first_open, 6) AS first_open,
  round(ret.sell / NULLIF(ret.buy, 0) - 1, 6) AS return
FROM fl JOIN ret USING (ticker, sample_id)""".replace("\n,", ","))
def feature_target_join(spark, sf):
    w = windows(spark, sf)
    x, _ = WN.lookback_horizon_split(w, L)
    lists = WN.window_feature_lists(x, ["date", "open"])
    j = WN.feature_target_join(lists, WN.forward_return(w, L))
    return j.select("ticker", WN.SAMPLE_ID, F.size("date").cast("bigint").alias("n_days"),
                    r6(F.element_at("open", 1)).alias("first_open"), r6("return").alias("return"))


PROJECTED = ("open", "close")


@query("feature_project", _windows_sql() + f""",
dn AS (SELECT date, sum({S.kw_count()}) AS kw FROM ({S.DATED_NEWS}) GROUP BY date)
SELECT sample_id, sw.date, CAST(kw AS BIGINT) AS keywords_count, round(open, 6) AS open, round(close, 6) AS close,
  dayname(sw.date) AS weekday, ticker FROM sw LEFT JOIN dn ON dn.date = sw.date WHERE day_idx < {L}""")
def feature_project(spark, sf):
    x, _ = WN.lookback_horizon_split(windows(spark, sf), L)
    x = WN.weekday_column(x.join(_daily_news(spark, sf).select("date", F.col("kw").alias("keywords_count")), "date", "left"))
    params = Params(frames=FX.BRAND_FRAMES, numerical_features=PROJECTED, textual_features=("weekday", "ticker"))
    p = WN.feature_project(x, params)
    return p.select(*[r6(c).alias(c) if c in PROJECTED else F.col(c) for c in p.columns])


def _daily_news_sql():
    return f"SELECT date, count(*) AS n_titles, sum({S.kw_count()}) AS kw FROM ({S.DATED_NEWS}) GROUP BY date"


def _daily_news(spark, sf):
    return N.daily_news_totals(N.keyword_count(FX.dated_news(spark, sf), FX.FIXTURE_KEYWORDS))


@query("price_news_join", _panel_sql(1) + f""",
dn AS ({_daily_news_sql()})
SELECT p.date, p.ticker, round(p.open, 6) AS open, dn.n_titles, CAST(dn.kw AS BIGINT) AS kw
FROM p LEFT JOIN dn ON dn.date = p.date""")
def price_news_join(spark, sf):
    j = panel(spark, sf).join(_daily_news(spark, sf), "date", "left")
    return j.select("date", "ticker", r6("open").alias("open"), "n_titles", "kw")


@query("price_news_outer", S.with_(b=S.BRAND_BARS)[:-1] + f""",
sl AS (SELECT * FROM b),
bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM sl),
grid AS (SELECT t.ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT ticker FROM sl) t, bounds),
p AS (SELECT g.date, g.ticker, sl.open FROM grid g LEFT JOIN sl ON sl.date = g.date AND sl.ticker = g.ticker),
dn AS ({_daily_news_sql()})
SELECT coalesce(p.date, dn.date) AS date, p.ticker, round(p.open, 6) AS open, dn.n_titles, CAST(dn.kw AS BIGINT) AS kw
FROM p FULL OUTER JOIN dn ON dn.date = p.date""")
def price_news_outer(spark, sf):
    p = B.calendar_fill(FX.brand_bars(spark, sf))
    j = p.join(_daily_news(spark, sf), "date", "full")
    return j.select("date", "ticker", r6("open").alias("open"), "n_titles", "kw")
