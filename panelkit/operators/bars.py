"""Daily bar operators: slice, reshape, calendar fill, as-of price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import business_days_before, safe_div
from ..params import BAR_METRICS
from .util import as_date, one_row_join


def present_metrics(df: DataFrame, metrics: Sequence[str] = BAR_METRICS) -> list[str]:
    return [m for m in metrics if m in df.columns]


def price_slice(bars: DataFrame, start, end, tickers=None) -> DataFrame:
    """Rows with start <= date <= end (both inclusive) and ticker in tickers."""
    out = bars.filter(F.col("date").between(as_date(start), as_date(end)))
    if tickers is not None:
        if isinstance(tickers, str):
            tickers = [tickers]
        out = out.filter(F.col("ticker").isin(list(tickers)))
    return out


def check_price_request(start, end, tickers, store_min, store_max, known) -> None:
    """Argument checks done on the driver before a plan is built."""
    start, end = as_date(start), as_date(end)
    if start > end:
        raise ValueError(f"the range runs backwards: {start} to {end}")
    if end < as_date(store_min) or start > as_date(store_max):
        raise ValueError(f"the store holds {store_min} to {store_max}, nothing of {start} to {end}")
    if isinstance(tickers, str):
        tickers = [tickers]
    if not tickers:
        raise ValueError("no ticker was asked for")
    unknown = [t for t in tickers if t not in set(known)]
    if unknown:
        raise ValueError(f"the store has no bars of {unknown}")


def price_catalog(bars: DataFrame) -> DataFrame:
    """One row: first and last date, sorted tickers and metric names."""
    metrics = present_metrics(bars)
    return bars.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("metrics", F.lit(",".join(metrics)))


def price_scan(bars: DataFrame, tickers, start, end) -> DataFrame:
    """Store load + slice with the store's checks, evaluated lazily.

    A ticker that is not in the store, or a range outside the store, fails
    the job through `raise_error` in the same pass that reads the rows.
    """
    if isinstance(tickers, str):
        tickers = [tickers]
    start, end = as_date(start), as_date(end)
    stats = bars.agg(
        F.min("date").alias("_lo"), F.max("date").alias("_hi"),
        F.size(F.array_except(F.array(*[F.lit(t) for t in tickers]),
                              F.collect_set("ticker"))).alias("_missing"))
    ok = (F.col("_missing") == 0) & (F.col("_lo") <= F.lit(start)) & (F.col("_hi") >= F.lit(end))
    sliced = price_slice(bars, start, end, tickers)
    return (one_row_join(sliced, stats)
            .filter(F.when(ok, F.lit(True)).otherwise(
                F.raise_error(F.lit("price_scan: unknown ticker or range outside the store"))))
            .drop("_lo", "_hi", "_missing"))


def price_unpivot(wide: DataFrame, metrics: Sequence[str] = BAR_METRICS,
                  id_col: str = "date") -> DataFrame:
    """Wide `<metric>_<ticker>` columns -> (date, metric, ticker, value)."""
    value_cols = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], value_cols, "name", "value")
    alt = "|".join(sorted(metrics, key=len, reverse=True))
    pat = rf"^({alt})_(.+)$"
    return long.select(
        id_col,
        F.regexp_extract("name", pat, 1).alias("metric"),
        F.regexp_extract("name", pat, 2).alias("ticker"),
        "value",
    )


def price_pivot_wide(bars: DataFrame, tickers: Sequence[str],
                     metrics: Sequence[str] = BAR_METRICS) -> DataFrame:
    """(date, ticker, metrics...) -> one row per date with `<metric>_<ticker>`."""
    aggs = [F.first(F.when(F.col("ticker") == t, F.col(m)), ignorenulls=True).alias(f"{m}_{t}")
            for m in metrics for t in tickers]
    return bars.filter(F.col("ticker").isin(list(tickers))).groupBy("date").agg(*aggs)


def price_pivot_bars(long: DataFrame, metrics: Sequence[str] = BAR_METRICS) -> DataFrame:
    """(date, metric, ticker, value) -> (date, ticker, <metric>...).

    Metric names are lower-cased with spaces as '_'.  A duplicated
    (date, ticker, metric) fails the job, as the reference's pivot does.
    """
    norm = long.withColumn("metric", F.regexp_replace(F.lower("metric"), " ", "_"))
    aggs = []
    for m in metrics:
        aggs.append(F.first(F.when(F.col("metric") == m, F.col("value")), ignorenulls=True).alias(m))
        aggs.append(F.count_if(F.col("metric") == m).alias(f"_n_{m}"))
    g = norm.groupBy("date", "ticker").agg(*aggs)
    dup = F.greatest(*[F.col(f"_n_{m}") for m in metrics]) > 1
    return (g.filter(F.when(dup, F.raise_error(F.lit("duplicate (date, ticker, metric)")))
                     .otherwise(F.lit(True)))
             .select("date", "ticker", *metrics))


def drop_incomplete_bars(bars: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Drop rows where any metric is NULL (NaN is treated as NULL)."""
    metrics = present_metrics(bars) if metrics is None else list(metrics)
    return bars.dropna(how="any", subset=metrics)


def nan_as_null(bars: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    metrics = present_metrics(bars) if metrics is None else list(metrics)
    return bars.select(*[
        F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c) if c in metrics else F.col(c)
        for c in bars.columns])


def calendar_fill(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every day between the first and last date x every ticker, left-joined
    to the bars; gaps are NULL, nothing is forward-filled.

    `by` are leading keys (e.g. split) with their own calendars.  The
    calendar grid is generated per (by, ticker) with `sequence`, so nothing
    calendar-sized is broadcast; the bounds are one row per `by` group.
    """
    by = list(by)
    bounds = bars.groupBy(*by).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    tickers = bars.select(*by, "ticker").distinct()
    if by:
        grid = tickers.join(bounds, on=by)
    else:
        grid = one_row_join(tickers, bounds)
    grid = grid.select(*by, "ticker", F.explode(F.sequence("_lo", "_hi")).alias("date"))
    return grid.join(bars, on=[*by, "date", "ticker"], how="left")


def _growth_rows(bounds: DataFrame, ticker: str, yearly_rate: float) -> DataFrame:
    daily = (1.0 + yearly_rate) ** (1.0 / 252.0) - 1.0
    days = bounds.select("_lo", F.explode(F.sequence("_lo", "_hi")).alias("date"))
    bd = days.filter(F.weekday("date") < 5)
    i = business_days_before("date") - business_days_before("_lo")
    v = F.pow(F.lit(1.0 + daily), i.cast("double"))
    return bd.select("date", F.lit(ticker).alias("ticker"),
                     v.alias("open"), v.alias("high"), v.alias("low"),
                     v.alias("close"), v.alias("adj_close"))


def growth_series(spark, start, end, ticker: str = "YEARLY_10_PERCENT",
                  yearly_rate: float = 0.1) -> DataFrame:
    """Synthetic ticker growing 10 % a year over business days.

    value = (1 + r) ** i with r = 1.1 ** (1/252) - 1 and i the 0-based index
    of the business day; i is computed arithmetically, not by a window.
    High/low carry the value too (the reference names them min/max); there
    is no volume.
    """
    bounds = spark.createDataFrame([(as_date(start), as_date(end))], "_lo date, _hi date")
    return _growth_rows(bounds, ticker, yearly_rate)


def growth_series_for(bars: DataFrame, ticker: str = "YEARLY_10_PERCENT",
                      yearly_rate: float = 0.1) -> DataFrame:
    """Growth series over the calendar span of a bar store."""
    bounds = bars.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    return _growth_rows(bounds, ticker, yearly_rate)


def market_grid(bars: DataFrame) -> DataFrame:
    """The reference's wide frame in long form: every market day (a date with
    any bar) x every ticker, left-joined to the bars."""
    days = bars.select("date").distinct()
    return calendar_fill(bars).join(days, "date", "left_semi")


def weekend_ffill(bars: DataFrame, start, end) -> DataFrame:
    """Reindex to every calendar day in [start, end]; a day with no bars takes
    the rows of the last earlier market day (a ticker missing there stays
    missing); days before the first market day stay empty.

    Works on the distinct market days (bounded by the calendar length), so
    the unpartitioned `lead` and the broadcast are calendar-sized.
    """
    start, end = as_date(start), as_date(end)
    sl = price_slice(bars, start, end)
    market = sl.select("date").distinct()
    nxt = F.lead("date").over(Window.orderBy("date"))
    spans = (market.withColumn("_next", nxt)
             .select(F.col("date").alias("_mday"),
                     F.explode(F.sequence(
                         "date", F.coalesce(F.date_sub("_next", 1), F.lit(end)))).alias("_day")))
    cols = [c for c in sl.columns if c != "date"]
    return (sl.join(spans, sl.date == spans._mday)
              .select(F.col("_day").alias("date"), *cols))


def asof_prices(bars: DataFrame, requests: DataFrame, metric,
                key: str = "ticker", date_col: str = "date",
                out=None) -> DataFrame:
    """Backward as-of: for each (key, date) of `requests`, the metric(s) of
    the latest complete bar of that key on or before the date (NULL if none).
    `metric` is one name (output column `out`, default "price") or a list
    (output columns `out` list, default the metric names) taken from the
    same bar in one pass.

    Skew-safe form: requests are reduced to distinct (key, date) first, the
    as-of runs in (key, year) buckets (at most ~2x366 rows each, however
    hot a key is) and the last bar of every earlier year is carried from a
    small (key, year) table.  The result is joined back on (key, date).
    """
    single = isinstance(metric, str)
    metrics = [metric] if single else list(metric)
    outs = ([out or "price"] if single else list(out or metrics))
    complete = drop_incomplete_bars(bars)
    vals = F.struct(*[F.col(m).alias(f"_m{i}") for i, m in enumerate(metrics)])
    b = complete.select(F.col("ticker").alias("_k"), F.col("date").alias("_d"),
                        vals.alias("_v"), F.lit(0).alias("_kind"))
    q = (requests.select(F.col(key).alias("_k"), F.col(date_col).alias("_d")).distinct()
         .select("_k", "_d", F.lit(None).cast(b.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_kind")))
    u = b.unionByName(q).withColumn("_y", F.year("_d"))
    w = (Window.partitionBy("_k", "_y").orderBy("_d", "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = (u.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
               .filter(F.col("_kind") == 1).select("_k", "_d", "_y", "_in"))
    year_last = b.groupBy("_k", F.year("_d").alias("_y")).agg(F.max_by("_v", "_d").alias("_yl"))
    # requests in a year with no bar at all need the carry of that year too
    req_years = within.select("_k", "_y").distinct()
    all_years = year_last.select("_k", "_y").unionByName(req_years).distinct()
    wy = Window.partitionBy("_k").orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    carry = (all_years.join(year_last, ["_k", "_y"], "left")
             .withColumn("_carry", F.last("_yl", ignorenulls=True).over(wy))
             .select("_k", "_y", "_carry"))
    best = F.coalesce("_in", "_carry")
    res = within.join(carry, ["_k", "_y"], "left").select(
        F.col("_k").alias(key), F.col("_d").alias(date_col),
        *[best[f"_m{i}"].alias(o) for i, o in enumerate(outs)])
    return requests.join(res, [key, date_col], "left")


def unanswerable(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """(ticker, date, problem) of the distinct requests a store cannot answer:
    a date outside the store's days, or a ticker the store does not have."""
    span = bars.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    known = bars.select("ticker").distinct().withColumn("_known", F.lit(True))
    asked = one_row_join(requests.select("ticker", "date").distinct(), span).join(known, "ticker", "left")
    return (asked.withColumn("problem", F.when(F.col("_known").isNull(), "unknown ticker")
                             .when((F.col("date") < F.col("_lo")) | (F.col("date") > F.col("_hi")), "date outside the store"))
            .filter("problem is not null").select("ticker", "date", "problem"))


def price_asof(bars: DataFrame, requests: DataFrame, metric: str = "close",
               store_min=None, strict: bool = False) -> DataFrame:
    """`get_price` as a join: price of (ticker, date) requests, stepping back
    to the latest complete bar; requests before the store start get NULL.
    `strict`: requests the store cannot answer raise instead."""
    if metric.lower() not in BAR_METRICS:
        raise ValueError(f"bars have no metric {metric}; they have {', '.join(BAR_METRICS)}")
    if strict and (bad := unanswerable(bars, requests).take(3)):
        raise ValueError("no price for " + ", ".join(f"{r.ticker} on {r.date}: {r.problem}" for r in bad))
    out = asof_prices(bars, requests, metric.lower())
    if store_min is not None:
        out = out.withColumn("price", F.when(F.col("date") >= F.lit(as_date(store_min)),
                                             F.col("price")))
    return out


def available_prices(bars: DataFrame, dates: DataFrame, at: str = "open",
                     trading_on_weekend: bool = False) -> DataFrame:
    """Price of every ticker for each requested date.

    With weekend trading the whole market steps back to the latest earlier
    day that has any complete bar; without it a closed day gives no rows
    (returned as a single row with NULL ticker and price).
    """
    complete = drop_incomplete_bars(bars).select("date", "ticker", F.col(at).alias("price"))
    mdays = complete.select(F.col("date").alias("_mday")).distinct()
    d = dates.select(F.col("date").alias("_req")).distinct()
    if trading_on_weekend:
        # as-of on the (small) set of market days
        u = (mdays.select(F.col("_mday").alias("_d"), F.col("_mday").alias("_m"), F.lit(0).alias("_kind"))
             .unionByName(d.select(F.col("_req").alias("_d"), F.lit(None).cast("date").alias("_m"),
                                   F.lit(1).alias("_kind"))))
        w = Window.partitionBy(F.year("_d")).orderBy("_d", "_kind").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        # a day's market day is within the same year or the last one of an
        # earlier year: resolve the year boundary with a second pass
        within = u.withColumn("_mm", F.last("_m", ignorenulls=True).over(w)).filter("_kind = 1")
        ylast = mdays.groupBy(F.year("_mday").alias("_y")).agg(F.max("_mday").alias("_yl"))
        req_years = within.select(F.year("_d").alias("_y")).distinct()
        yrs = ylast.select("_y").unionByName(req_years).distinct().join(ylast, "_y", "left")
        yrs = yrs.withColumn("_carry", F.last("_yl", ignorenulls=True).over(
            Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)))
        m = (within.join(yrs.select("_y", "_carry"), F.year(within._d) == yrs._y, "left")
             .select(F.col("_d").alias("_req"), F.coalesce("_mm", "_carry").alias("_mday")))
    else:
        m = d.join(mdays, d._req == mdays._mday, "left").select("_req", "_mday")
    return (m.join(complete, m._mday == complete.date, "left")
             .select(F.col("_req").alias("date"), "ticker", "price"))


def n_day_return(bars: DataFrame, n: int, metric: str = "adj_close") -> DataFrame:
    """`pct_change(n)` per ticker over its trading rows: pad NULLs forward
    first, then value / value n rows earlier - 1; NULL results dropped."""
    w = Window.partitionBy("ticker").orderBy("date")
    padded = bars.withColumn("_p", F.last(metric, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = safe_div(F.col("_p"), F.lag("_p", n).over(w)) - F.lit(1.0)
    return (padded.select("date", "ticker", r.alias("ret"))
                  .filter(F.col("ret").isNotNull() & ~F.isnan("ret")))


def n_day_returns(bars: DataFrame, ns, metric: str = "adj_close") -> DataFrame:
    """`n_day_return` for several n in one window pass: one padded series,
    one lag per n, unpivoted to (date, ticker, n, ret)."""
    w = Window.partitionBy("ticker").orderBy("date")
    padded = bars.withColumn("_p", F.last(metric, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cols = [(safe_div(F.col("_p"), F.lag("_p", n).over(w)) - F.lit(1.0)).alias(f"r{n}") for n in ns]
    wide = padded.select("date", "ticker", *cols)
    long = wide.unpivot(["date", "ticker"], [f"r{n}" for n in ns], "_n", "ret")
    return (long.filter(F.col("ret").isNotNull() & ~F.isnan("ret"))
                .select("date", "ticker", F.substring("_n", 2, 10).cast("int").alias("n"), "ret"))


def overnight_return(bars: DataFrame) -> DataFrame:
    """Next row's open / this row's adj_close - 1, per ticker."""
    w = Window.partitionBy("ticker").orderBy("date")
    r = safe_div(F.lead("open", 1).over(w), F.col("adj_close")) - F.lit(1.0)
    return bars.select("date", "ticker", r.alias("ret")).filter(F.col("ret").isNotNull())


def return_pair_trim(overnight: DataFrame, one_day: DataFrame) -> DataFrame:
    """(ticker, date, return_type, ret): per ticker both series cut to the length
    of the shorter, from their first days on.  A ticker's series has at most one
    row per calendar day."""
    both = (overnight.select("ticker", "date", "ret", F.lit("Overnight").alias("return_type"))
            .unionByName(one_day.select("ticker", "date", "ret", F.lit("1-day").alias("return_type"))))
    length = (both.groupBy("ticker").agg(F.count_if(F.col("return_type") == "Overnight").alias("_a"),
                                         F.count_if(F.col("return_type") == "1-day").alias("_b"))
              .select("ticker", F.least("_a", "_b").alias("_n")))
    at = F.row_number().over(Window.partitionBy("ticker", "return_type").orderBy("date"))
    return (both.withColumn("_at", at).join(length, "ticker").filter(F.col("_at") <= F.col("_n"))
            .select("ticker", "date", "return_type", "ret"))
