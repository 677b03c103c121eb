"""Catalog: account ledger operators over the trades fixture.

Money columns are running sums of cent amounts that reach ~1e10 here; they
are rounded to cents in both engines (the summation order differs in the
last binary digits, far below a cent).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as AC
from ..operators import predict as PD
from ..sources import fixtures as FX
from . import oracle_sql as S
from .catalog import query
from .q_pipeline import LABELS, _dataset
from .q_prompts import PROMPT_SQL, _GT_SQL

# The main experiment's budget (initial amount, monthly budget)
# and the bank's default prices (buy at open, sell at close).
INITIAL, MONTHLY = 10000.0, 1000.0
BUY_AT, SELL_AT = "open", "close"
BUY_LABELS, SELL_LABELS = ("very good",), ("very bad",)
ZERO_FILL_SYMBOLS = tuple(f"Brand#{n}" for n in range(1, 26))


def r0(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 2)


def _args(spark, sf):
    return FX.staged(FX.trades(spark, sf), "trades"), FX.staged(FX.brand_bars(spark, sf), "brand_bars")


_DEP = (f"CAST({INITIAL} + {MONTHLY} * ((year(days.date) * 12 + month(days.date)) - (year(f) * 12 + month(f)) "
        "+ CASE WHEN day(f) = 1 THEN 1 ELSE 0 END) AS DOUBLE)")

def _ledger_sql(accepted: bool = False) -> str:
    """px: every order with its prices; pos, cash, held: the state, of the accepted
    orders where `accepted`."""
    done = "WHERE accepted" if accepted else ""
    trades = f"SELECT *, {_ACCEPTED} AS accepted FROM ({S.TRADES})" if accepted else S.TRADES
    return S.with_(t=trades, b=S.BRAND_BARS)[:-1] + f""",
px AS (SELECT t.*, (SELECT bo.{BUY_AT} FROM b bo WHERE bo.ticker = t.symbol AND bo.date <= t.date ORDER BY bo.date DESC LIMIT 1) AS buy_px,
              (SELECT bc.{SELL_AT} FROM b bc WHERE bc.ticker = t.symbol AND bc.date <= t.date ORDER BY bc.date DESC LIMIT 1) AS sell_px
       FROM t),
pos AS (SELECT account, symbol, date, CAST(sum(sum(CASE WHEN side = 'buy' THEN shares ELSE -shares END))
          OVER (PARTITION BY account, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS shares
        FROM t {done} GROUP BY account, symbol, date),
fst AS (SELECT account, min(date) AS f FROM t GROUP BY account),
flows AS (SELECT account, date, sum(CASE WHEN side = 'buy' THEN -shares * buy_px ELSE shares * sell_px END) AS flow
          FROM px {done} GROUP BY account, date),
days AS (SELECT account, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM t GROUP BY account),
cash AS (SELECT days.account, days.date, {_DEP} AS total_deposits,
           {_DEP} + sum(coalesce(flow, 0)) OVER (PARTITION BY days.account ORDER BY days.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cash
         FROM days JOIN fst USING (account) LEFT JOIN flows fl ON fl.account = days.account AND fl.date = days.date),
held AS (SELECT d.account, d.date, p.symbol, p.shares FROM days d
         JOIN (SELECT DISTINCT account, symbol FROM t) s ON s.account = d.account
         ASOF JOIN pos p ON p.account = d.account AND p.symbol = s.symbol AND d.date >= p.date)"""


# state as a day begins
_OPEN_SQL = """,
asked AS (SELECT DISTINCT account, symbol, date FROM t),
hb AS (SELECT a.account, a.symbol, a.date, coalesce(last_value(p.shares IGNORE NULLS) OVER (PARTITION BY a.account, a.symbol ORDER BY a.date
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before
       FROM asked a LEFT JOIN pos p ON p.account = a.account AND p.symbol = a.symbol AND p.date = a.date),
co AS (SELECT account, date, coalesce(lag(cash) OVER w, 0) + total_deposits - coalesce(lag(total_deposits) OVER w, 0) AS cash_open
       FROM cash WINDOW w AS (PARTITION BY account ORDER BY date))"""
# Some orders were refused: stand-in for a ledger that says which.
_ACCEPTED = "(shares * 7 + account) % 5 <> 0"
LEDGER_SQL = _ledger_sql()


def _refusing(trades):
    return trades.withColumn("accepted", (F.col("shares") * 7 + F.col("account")) % 5 != 0)


@query("trade_signal", PROMPT_SQL + f""",
gt AS (SELECT DISTINCT "index", {_GT_SQL} AS label FROM prompts)
SELECT "index", label, CASE WHEN label IN ('very good') THEN 'buy' WHEN label IN ('very bad') THEN 'sell' ELSE 'hold' END AS signal
FROM gt""")
def trade_signal(spark, sf):
    preds = PD.predict_ground_truth(_dataset(spark, sf), LABELS)
    return AC.trade_signal(preds, "label", BUY_LABELS, SELL_LABELS)


@query("order_size", LEDGER_SQL + _OPEN_SQL + """
SELECT * FROM (SELECT px.account, px.date, px.symbol, px.side, CASE WHEN side = 'buy' THEN CAST(floor(round(cash_open, 2) / buy_px) AS BIGINT)
    ELSE CAST(held_before AS BIGINT) END AS order_shares
  FROM px LEFT JOIN co USING (account, date) LEFT JOIN hb USING (account, symbol, date)) WHERE order_shares > 0""")
def order_size(spark, sf):
    """Sizes from the ledger's own cash and holdings as each day begins."""
    t, b = _args(spark, sf)
    return AC.sized_orders(t, b, BUY_AT, SELL_AT, INITIAL, MONTHLY).select("account", "date", "symbol", "side", "order_shares")


def _positions(t, b):
    lp = AC.ledger_positions(t, b, BUY_AT, SELL_AT, INITIAL, MONTHLY)
    return lp.select("account", "date", "symbol", "shares", r0("cash").alias("cash"))


_POSITIONS_SQL = """
SELECT pos.account, pos.date, pos.symbol, pos.shares, round(cash.cash, 2) AS cash
FROM pos LEFT JOIN cash USING (account, date) WHERE pos.shares <> 0"""


@query("ledger_positions", LEDGER_SQL + _POSITIONS_SQL)
def ledger_positions(spark, sf):
    return _positions(*_args(spark, sf))


@query("ledger_positions_accepted", _ledger_sql(True) + _POSITIONS_SQL)
def ledger_positions_accepted(spark, sf):
    """Refused orders change nothing."""
    t, b = _args(spark, sf)
    return _positions(_refusing(t), b)


def _checks_sql(accepted: bool = False) -> str:
    done = "accepted" if accepted else "TRUE"
    return _ledger_sql(accepted) + _OPEN_SQL + f""",
pr AS (SELECT account, date, sum(shares * sell_px) AS proceeds FROM px WHERE side = 'sell' AND {done} GROUP BY account, date),
bu AS (SELECT px.*, coalesce(sum(CASE WHEN {done} THEN shares * buy_px END) OVER (PARTITION BY account, date ORDER BY symbol
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM px WHERE side = 'buy'),
bb AS (SELECT bu.account, bu.date, bu.symbol, bu.side, bu.shares,
         CASE WHEN bu.shares <= 0 THEN 'non_positive'
              WHEN bu.shares * bu.buy_px > co.cash_open + coalesce(pr.proceeds, 0) - bu.spent THEN 'insufficient_cash' END AS violation
       FROM bu LEFT JOIN co USING (account, date) LEFT JOIN pr USING (account, date)),
sb AS (SELECT px.account, px.date, px.symbol, px.side, px.shares,
         CASE WHEN px.shares <= 0 THEN 'non_positive' WHEN hb.held_before <= 0 THEN 'not_owned'
              WHEN hb.held_before < px.shares THEN 'insufficient_shares' END AS violation
       FROM px LEFT JOIN hb USING (account, symbol, date) WHERE px.side = 'sell')
SELECT * FROM bb WHERE violation IS NOT NULL UNION ALL SELECT * FROM sb WHERE violation IS NOT NULL"""


@query("order_checks", _checks_sql())
def order_checks(spark, sf):
    t, b = _args(spark, sf)
    return AC.order_checks(t, b, BUY_AT, SELL_AT, INITIAL, MONTHLY)


@query("order_checks_accepted", _checks_sql(True))
def order_checks_accepted(spark, sf):
    t, b = _args(spark, sf)
    return AC.order_checks(_refusing(t), b, BUY_AT, SELL_AT, INITIAL, MONTHLY)


@query("monthly_deposits", S.with_(t=S.TRADES) + f""",
sp AS (SELECT account, min(date) AS f, max(date) AS l FROM t GROUP BY account)
SELECT account, f AS date, {INITIAL} AS amount FROM sp
UNION ALL
SELECT account, CAST(d AS DATE) AS date, {MONTHLY} AS amount FROM (
  SELECT account, l, unnest(generate_series(CASE WHEN day(f) = 1 THEN f ELSE CAST(date_trunc('month', f) AS DATE) + INTERVAL 1 MONTH END,
                                            l, INTERVAL 1 MONTH)) AS d FROM sp)""".replace("\n,", ","))
def monthly_deposits(spark, sf):
    return AC.monthly_deposits(FX.trades(spark, sf), INITIAL, MONTHLY)


_VAL_SQL = LEDGER_SQL + f""",
hv AS (SELECT h.account, h.date, sum(h.shares * (SELECT bc.{SELL_AT} FROM b bc WHERE bc.ticker = h.symbol AND bc.date <= h.date
         ORDER BY bc.date DESC LIMIT 1)) AS holdings_value FROM held h WHERE h.shares <> 0 GROUP BY h.account, h.date),
val AS (SELECT cash.account, cash.date, cash.cash, cash.total_deposits, coalesce(hv.holdings_value, 0) AS holdings_value,
          cash.cash + coalesce(hv.holdings_value, 0) AS total_value FROM cash LEFT JOIN hv USING (account, date))"""


@query("portfolio_value", _VAL_SQL + """
SELECT account, date, round(cash, 2) AS cash, round(holdings_value, 2) AS holdings_value,
  round(total_value, 2) AS total_value, round(total_deposits, 2) AS total_deposits FROM val""")
def portfolio_value(spark, sf):
    t, b = _args(spark, sf)
    v = AC.portfolio_value(t, b, BUY_AT, SELL_AT, INITIAL, MONTHLY)
    return v.select("account", "date", *[r0(c).alias(c) for c in ("cash", "holdings_value", "total_value",
                                                                   "total_deposits")])


@query("profit_metrics", _VAL_SQL + """
SELECT account, date, round(total_value - total_deposits, 2) AS total_profit,
  round(total_value - total_deposits, 2) / NULLIF(total_deposits, 0) AS profit_percentage FROM val""")
def profit_metrics(spark, sf):
    t, b = _args(spark, sf)
    p = AC.profit_metrics(AC.portfolio_value(t, b, BUY_AT, SELL_AT, INITIAL, MONTHLY))
    # percentage shown from the cent-rounded profit (both engines), so float
    # noise of the ~1e9 running sums cannot flip a rounding boundary
    return p.select("account", "date", r0("total_profit").alias("total_profit"),
                    F.try_divide(r0("total_profit"), F.col("total_deposits")).alias("profit_percentage"))


@query("holdings_zero_fill", LEDGER_SQL + f""",
sy AS (SELECT unnest({S.labels_sql(ZERO_FILL_SYMBOLS)}) AS symbol)
SELECT d.account, d.date, sy.symbol, coalesce(h.shares, 0) AS shares
FROM days d CROSS JOIN sy LEFT JOIN held h ON h.account = d.account AND h.date = d.date AND h.symbol = sy.symbol""")
def holdings_zero_fill(spark, sf):
    return AC.holdings_zero_fill(FX.staged(FX.trades(spark, sf), "trades"), ZERO_FILL_SYMBOLS)
