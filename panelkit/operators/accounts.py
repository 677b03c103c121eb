"""Account ledger as data-parallel table operators (the day-by-day trading
loop of the reference re-aimed at order/ledger tables).

Running sums are taken on per-day aggregates: trades are first reduced to one
row per (account, symbol, day) / (account, day) with map-side combine, so an
ordered window holds at most one row per calendar day of one account (and
symbol), however many trades a busy account has.  Within a day, sells settle
before buys (the reference's order).

Which orders execute depends on every earlier refusal, so a ledger of orders may
say so itself: where the table has a boolean `accepted`, holdings and cash are those
of the accepted orders alone (NULL is not accepted), and `order_checks` holds every
order against that state.  Without the column every order counts as executed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .bars import asof_prices


def trade_signal(df: DataFrame, label: str, buy_labels: Sequence[str],
                 sell_labels: Sequence[str], out: str = "signal") -> DataFrame:
    c = F.col(label)
    return df.withColumn(out, F.when(c.isin(list(buy_labels)), F.lit("buy"))
                         .when(c.isin(list(sell_labels)), F.lit("sell")).otherwise(F.lit("hold")))


def order_size(df: DataFrame, signal: str = "side", cash: str = "cash", price: str = "price",
               held: str = "held", out: str = "order_shares") -> DataFrame:
    """buy: int(cash / price) shares; sell: everything held; rows with no
    positive order are dropped (a Decision keeps positive entries only)."""
    buy = F.floor(safe_div(F.col(cash), F.col(price))).cast("bigint")
    qty = (F.when(F.col(signal) == "buy", buy)
            .when(F.col(signal) == "sell", F.col(held).cast("bigint")))
    return df.withColumn(out, qty).filter(F.col(out) > 0)


def _priced(trades: DataFrame, bars: DataFrame, buying_at: str, selling_at: str) -> DataFrame:
    req = trades.select(F.col("symbol").alias("ticker"), "date").distinct()
    px = asof_prices(bars, req, [buying_at, selling_at], out=["buy_px", "sell_px"]) \
        .withColumnRenamed("ticker", "symbol")
    return trades.join(px, ["symbol", "date"], "left")


def signed_shares(side="side", shares="shares"):
    return F.when(F.col(side) == "buy", F.col(shares)).otherwise(-F.col(shares))


def is_executed(trades: DataFrame):
    """Whether an order changes the account."""
    return F.coalesce(F.col("accepted"), F.lit(False)) if "accepted" in trades.columns else F.lit(True)


def daily_positions(trades: DataFrame) -> DataFrame:
    """(account, symbol, date, shares): holdings after each trading day."""
    d = trades.filter(is_executed(trades)).groupBy("account", "symbol", "date").agg(F.sum(signed_shares()).alias("_net"))
    w = Window.partitionBy("account", "symbol").orderBy("date") \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("account", "symbol", "date", F.sum("_net").over(w).cast("bigint").alias("shares"))


def deposits_until(first_date, d, initial: float, monthly: float):
    """Initial amount plus one monthly budget per 1st-of-month in [first, d]."""
    f, x = F.col(first_date) if isinstance(first_date, str) else first_date, F.col(d) if isinstance(d, str) else d
    months = (F.year(x) * 12 + F.month(x)) - (F.year(f) * 12 + F.month(f)) \
        + F.when(F.dayofmonth(f) == 1, 1).otherwise(0)
    extra = months * F.lit(float(monthly)) if monthly > 0 else F.lit(0.0)
    return F.lit(float(initial)) + extra


def account_days(trades: DataFrame) -> DataFrame:
    """(account, date, _first): every calendar day from an account's first order
    to its last."""
    span = trades.groupBy("account").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    return span.select("account", F.explode(F.sequence("_first", "_last")).alias("date"), "_first")


def daily_cash(trades: DataFrame, bars: DataFrame, buying_at: str = "open", selling_at: str = "close",
               initial: float = 0.0, monthly: float = 0.0) -> DataFrame:
    """(account, date, cash, total_deposits) at the end of every calendar day:
    deposits minus buy costs (at `buying_at`) plus sell proceeds (at
    `selling_at`)."""
    p = _priced(trades, bars, buying_at, selling_at)
    flow = F.when(F.col("side") == "buy", -F.col("shares") * F.col("buy_px")) \
            .otherwise(F.col("shares") * F.col("sell_px"))
    d = p.filter(is_executed(p)).groupBy("account", "date").agg(F.sum(flow).alias("_flow"))
    days = account_days(trades).join(d, ["account", "date"], "left")
    w = Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dep = deposits_until("_first", "date", initial, monthly)
    return days.select("account", "date", dep.alias("total_deposits"),
                       (dep + F.sum(F.coalesce("_flow", F.lit(0.0))).over(w)).alias("cash"))


def ledger_positions(trades: DataFrame, bars: DataFrame, buying_at: str = "open",
                     selling_at: str = "close", initial: float = 0.0, monthly: float = 0.0) -> DataFrame:
    """Holdings per (account, date, symbol) after each of the symbol's
    trading days (emptied positions removed) with the account's cash."""
    pos = daily_positions(trades).filter(F.col("shares") != 0)
    cash = daily_cash(trades, bars, buying_at, selling_at, initial, monthly)
    return pos.join(cash.select("account", "date", "cash"), ["account", "date"], "left")


def holdings_before(trades: DataFrame) -> DataFrame:
    """(account, symbol, date, held_before): holdings as each order day begins, for
    every day with an order of the symbol."""
    moves = daily_positions(trades)
    asked = trades.select("account", "symbol", "date").distinct().join(moves, ["account", "symbol", "date"], "left")
    w = Window.partitionBy("account", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return asked.select("account", "symbol", "date",
                        F.coalesce(F.last("shares", ignorenulls=True).over(w), F.lit(0)).alias("held_before"))


def cash_at_open(trades: DataFrame, bars: DataFrame, buying_at: str = "open", selling_at: str = "close",
                 initial: float = 0.0, monthly: float = 0.0) -> DataFrame:
    """(account, date, cash_open): the previous day's cash and the deposits since."""
    cash = daily_cash(trades, bars, buying_at, selling_at, initial, monthly)
    w = Window.partitionBy("account").orderBy("date")
    since = F.col("total_deposits") - F.coalesce(F.lag("total_deposits").over(w), F.lit(0.0))
    return cash.select("account", "date", (F.coalesce(F.lag("cash").over(w), F.lit(0.0)) + since).alias("cash_open"))


def sized_orders(trades: DataFrame, bars: DataFrame, buying_at: str = "open", selling_at: str = "close",
                 initial: float = 0.0, monthly: float = 0.0) -> DataFrame:
    """What each order could be at most as its day begins, by `order_size`: a buy from
    the ledger's cash at the as-of buying price, a sell from its holdings."""
    p = _priced(trades, bars, buying_at, selling_at)
    p = (p.join(cash_at_open(trades, bars, buying_at, selling_at, initial, monthly), ["account", "date"], "left")
         .join(holdings_before(trades), ["account", "symbol", "date"], "left")
         .withColumn("cash_open", F.round("cash_open", 2)))
    return order_size(p, "side", "cash_open", "buy_px", "held_before")


def order_checks(trades: DataFrame, bars: DataFrame, buying_at: str = "open",
                 selling_at: str = "close", initial: float = 0.0, monthly: float = 0.0) -> DataFrame:
    """Orders the account could not execute, with the rule broken:
    non_positive shares, not_owned / insufficient_shares on sells (holdings
    after the earlier sells of the day), insufficient_cash on buys (cash after
    the day's sells and its earlier buys, taken in symbol order).  Several
    orders of one symbol and day go by `order_id`, where the table has it, else
    by size.  The state is that of the executed orders (`is_executed`)."""
    order = ["order_id"] if "order_id" in trades.columns else []
    held_before = holdings_before(trades)
    cash_open = cash_at_open(trades, bars, buying_at, selling_at, initial, monthly)
    p = _priced(trades, bars, buying_at, selling_at)
    done = is_executed(p)
    sells = p.filter((F.col("side") == "sell") & done).groupBy("account", "date") \
             .agg(F.sum(F.col("shares") * F.col("sell_px")).alias("_proceeds"))
    buys = p.filter(F.col("side") == "buy")
    w_day = Window.partitionBy("account", "date").orderBy("symbol", *order, "shares") \
                  .rowsBetween(Window.unboundedPreceding, -1)
    buys = buys.withColumn("_spent_before", F.coalesce(
        F.sum(F.when(done, F.col("shares") * F.col("buy_px"))).over(w_day), F.lit(0.0)))
    buys = (buys.join(cash_open, ["account", "date"], "left").join(sells, ["account", "date"], "left")
            .withColumn("cash_available", F.col("cash_open") + F.coalesce("_proceeds", F.lit(0.0))
                        - F.col("_spent_before")))
    buy_bad = buys.select(
        "account", "date", "symbol", *order, "side", "shares",
        F.when(F.col("shares") <= 0, F.lit("non_positive"))
         .when(F.col("shares") * F.col("buy_px") > F.col("cash_available"), F.lit("insufficient_cash"))
         .alias("violation"))
    w_sold = Window.partitionBy("account", "symbol", "date").orderBy(*order, "shares") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    s = (p.filter(F.col("side") == "sell").withColumn("_sold_before", F.coalesce(
        F.sum(F.when(done, F.col("shares"))).over(w_sold), F.lit(0)))
         .join(held_before, ["account", "symbol", "date"], "left")
         .withColumn("held_before", F.col("held_before") - F.col("_sold_before")))
    sell_bad = s.select(
        "account", "date", "symbol", *order, "side", "shares",
        F.when(F.col("shares") <= 0, F.lit("non_positive"))
         .when(F.col("held_before") <= 0, F.lit("not_owned"))
         .when(F.col("held_before") < F.col("shares"), F.lit("insufficient_shares"))
         .alias("violation"))
    return buy_bad.unionByName(sell_bad).filter(F.col("violation").isNotNull())


def monthly_deposits(trades: DataFrame, initial: float, monthly: float) -> DataFrame:
    """Deposits per account: the initial amount on its first day and the
    monthly budget on every 1st of a month until its last day."""
    span = trades.groupBy("account").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    init = span.select("account", F.col("_first").alias("date"), F.lit(float(initial)).alias("amount"))
    if monthly <= 0:
        return init
    first_month = F.when(F.dayofmonth("_first") == 1, F.col("_first")) \
                   .otherwise(F.add_months(F.trunc("_first", "month"), 1))
    months = span.select("account", "_last", F.explode(F.sequence(
        first_month, F.trunc("_last", "month"), F.expr("INTERVAL 1 MONTH"))).alias("date"))
    dep = months.filter(F.col("date") <= F.col("_last")).select(
        "account", "date", F.lit(float(monthly)).alias("amount"))
    return init.unionByName(dep)


def positions_on_days(trades: DataFrame, days: DataFrame) -> DataFrame:
    """Non-zero holdings on each requested (account, date): each position change
    is valid until the next one; only spans that hold something are expanded."""
    pos = daily_positions(trades)
    w = Window.partitionBy("account", "symbol").orderBy("date")
    last = days.groupBy("account").agg(F.max("date").alias("_last"))
    spans = (pos.withColumn("_next", F.lead("date").over(w)).filter(F.col("shares") != 0).join(last, "account")
             .select("account", "symbol", "shares",
                     F.explode(F.sequence("date", F.coalesce(F.date_sub("_next", 1), F.col("_last"))))
                     .alias("date")))
    return spans.join(days, ["account", "date"], "left_semi")


def portfolio_value(trades: DataFrame, bars: DataFrame, buying_at: str = "open",
                    selling_at: str = "close", initial: float = 0.0, monthly: float = 0.0) -> DataFrame:
    """Per account and calendar day: cash, holdings at the as-of selling price,
    total value and deposits so far."""
    held = positions_on_days(trades, account_days(trades))
    priced = asof_prices(bars, held.withColumnRenamed("symbol", "ticker"), selling_at, out="px")
    hv = priced.groupBy("account", "date").agg(F.sum(F.col("shares") * F.col("px")).alias("holdings_value"))
    cash = daily_cash(trades, bars, buying_at, selling_at, initial, monthly)
    out = cash.join(hv, ["account", "date"], "left").withColumn(
        "holdings_value", F.coalesce("holdings_value", F.lit(0.0)))
    return out.withColumn("total_value", F.col("cash") + F.col("holdings_value"))


def profit_metrics(values: DataFrame) -> DataFrame:
    """total_profit = value - deposits; profit_percentage = profit / deposits."""
    profit = F.col("total_value") - F.col("total_deposits")
    return values.withColumn("total_profit", profit) \
                 .withColumn("profit_percentage", safe_div(profit, F.col("total_deposits")))


def holdings_zero_fill(trades: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """(account, date, symbol, shares) for every configured symbol on every
    calendar day of the account, 0 when not held."""
    days = account_days(trades).select("account", "date")
    held = positions_on_days(trades, days)
    grid = days.select("account", "date", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"))
    return grid.join(held, ["account", "date", "symbol"], "left").select(
        "account", "date", "symbol", F.coalesce("shares", F.lit(0)).cast("bigint").alias("shares"))
