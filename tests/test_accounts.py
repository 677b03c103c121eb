import datetime as dt

from panelkit.operators import accounts as AC


def test_order_size_rules(spark):
    df = spark.createDataFrame([("buy", 1003.0, 150.0, 0), ("buy", 1003.0, 100.0, 0), ("sell", 0.0, 1.0, 5),
                                ("buy", 1.0, 150.0, 0), ("sell", 0.0, 1.0, 0), ("hold", 5.0, 1.0, 3)],
                               "side string, cash double, price double, held long")
    got = [(r.side, r.order_shares) for r in AC.order_size(df).collect()]
    assert got == [("buy", 6), ("buy", 10), ("sell", 5)]


def test_trade_signal(spark):
    df = spark.createDataFrame([("very good",), ("very bad",), ("neutral",), (None,)], "label string")
    got = [r.signal for r in AC.trade_signal(df, "label", ["very good"], ["very bad"]).collect()]
    assert got == ["buy", "sell", "hold", "hold"]


def _ledger(spark):
    d = dt.date
    bars = spark.createDataFrame([(d(2023, 1, 2), "A", 10.0, 11.0), (d(2023, 1, 3), "A", 12.0, 13.0),
                                  (d(2023, 2, 1), "A", 20.0, 21.0)],
                                 "date date, ticker string, open double, close double")
    trades = spark.createDataFrame([(0, d(2023, 1, 2), "A", "buy", 5), (0, d(2023, 1, 3), "A", "sell", 2),
                                    (0, d(2023, 2, 1), "A", "sell", 9), (0, d(2023, 2, 1), "A", "buy", 1)],
                                   "account long, date date, symbol string, side string, shares long")
    return trades, bars


def test_ledger_cash_positions_and_checks(spark):
    trades, bars = _ledger(spark)
    cash = {r.date.isoformat(): (r.cash, r.total_deposits)
            for r in AC.daily_cash(trades, bars, "open", "close", 100.0, 10.0).collect()}
    assert cash["2023-01-02"] == (100.0 - 50.0, 100.0)
    assert cash["2023-01-03"] == (50.0 + 26.0, 100.0)
    assert cash["2023-02-01"] == (76.0 + 10.0 + 9 * 21.0 - 20.0, 110.0)
    pos = {(r.date.isoformat(), r.symbol): r.shares for r in AC.daily_positions(trades).collect()}
    assert pos[("2023-01-03", "A")] == 3 and pos[("2023-02-01", "A")] == -5
    bad = {(r.date.isoformat(), r.side): r.violation for r in AC.order_checks(trades, bars, "open", "close",
                                                                               100.0, 10.0).collect()}
    assert bad == {("2023-02-01", "sell"): "insufficient_shares"}


def test_portfolio_value_and_deposits(spark):
    trades, bars = _ledger(spark)
    v = {r.date.isoformat(): r for r in AC.profit_metrics(
        AC.portfolio_value(trades, bars, "open", "close", 100.0, 10.0)).collect()}
    assert v["2023-01-02"].holdings_value == 5 * 11.0
    assert v["2023-01-02"].total_value == 50.0 + 55.0
    assert abs(v["2023-01-02"].profit_percentage - 0.05) < 1e-12
    dep = sorted((r.date.isoformat(), r.amount) for r in AC.monthly_deposits(trades, 100.0, 10.0).collect())
    assert dep == [("2023-01-02", 100.0), ("2023-02-01", 10.0)]
    zf = AC.holdings_zero_fill(trades, ["A", "B"]).filter("symbol = 'B'").collect()
    assert {r.shares for r in zf} == {0}


def test_orders_of_one_symbol_and_day_add_up(spark):
    d = dt.date
    bars = spark.createDataFrame([(d(2023, 1, 2), "A", 10.0, 10.0)], "date date, ticker string, open double, close double")
    orders = spark.createDataFrame(
        [(0, d(2023, 1, 2), "A", 1, "buy", 6), (0, d(2023, 1, 4), "A", 2, "sell", 5), (0, d(2023, 1, 4), "A", 3, "sell", 5),
         (0, d(2023, 1, 5), "A", 4, "buy", 4), (0, d(2023, 1, 5), "A", 5, "buy", 4)],
        "account long, date date, symbol string, order_id long, side string, shares long")
    bad = {r.order_id: r.violation for r in AC.order_checks(orders, bars, initial=100.0).collect()}
    # 100 - 60 + 100 (both sells counted) leaves 140; the second sell had 1 share left
    assert bad == {3: "insufficient_shares"}
    values = {r.date: r for r in AC.portfolio_value(orders, bars, initial=100.0).collect()}
    assert sorted(values) == [d(2023, 1, k) for k in (2, 3, 4, 5)]       # every calendar day
    assert values[d(2023, 1, 3)].cash == 40.0 and values[d(2023, 1, 3)].holdings_value == 60.0


def test_refused_orders_change_nothing(spark):
    trades, bars = _ledger(spark)
    kept = trades.filter("shares <> 9")
    marked = trades.selectExpr("*", "CASE WHEN shares = 9 THEN NULL ELSE true END AS accepted")
    for fn in (AC.ledger_positions, AC.portfolio_value):
        got, want = (sorted(map(tuple, fn(t, bars, "open", "close", 100.0).collect())) for t in (marked, kept))
        assert got == want and got
    # the refused order is still held against the state, which it leaves as it is
    bad = AC.order_checks(marked, bars, "open", "close", 100.0).collect()
    assert [(r.side, r.shares, r.violation) for r in bad] == [("sell", 9, "insufficient_shares")]
    none = trades.selectExpr("*", "false AS accepted")
    assert AC.ledger_positions(none, bars, "open", "close", 100.0).count() == 0
    assert {r.violation for r in AC.order_checks(none, bars, "open", "close", 100.0).collect()} == {"not_owned"}


def test_sized_orders_from_cash_and_holdings(spark):
    trades, bars = _ledger(spark)
    trades = trades.filter("shares <> 9")
    got = {(r.date, r.side): r.order_shares for r in AC.sized_orders(trades, bars, "open", "close", 100.0).collect()}
    d = dt.date
    # 100 buys ten at 10; five are held at the sell; 50 + 26 then buys three at 20
    assert got == {(d(2023, 1, 2), "buy"): 10, (d(2023, 1, 3), "sell"): 5, (d(2023, 2, 1), "buy"): 3}
