"""Sliding look-back/horizon windows over a calendar-filled (ticker, date) panel.

The panel is dense (one row per ticker per calendar day), so a row's position
is `datediff(date, first_day)` and the windows holding it are an arithmetic
range.  Windows are produced by `explode(sequence(...))` and later gathered by
a hash group-by on (split, ticker, sample_id): every group has exactly W rows,
so no key can become hot, and no ordered per-ticker window is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div, weekday_name
from .util import one_row_join

SAMPLE_ID = "sample_id"
DAY_IDX = "day_idx"
AGGREGATIONS = ("first", "last", "mean", "max", "min")


BOUNDS = ("_lo", "_hi")


def with_bounds(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The panel with its first and last day (per `by`), where it has not got them."""
    if set(BOUNDS) <= set(panel.columns):
        return panel
    bounds = panel.groupBy(*by).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    if by:
        return panel.join(bounds, on=list(by))
    return one_row_join(panel, bounds)


def window_positions(panel: DataFrame, window: int, by: Sequence[str] = ()) -> DataFrame:
    """Every window of `window` consecutive days: adds sample_id (0-based start
    offset) and day_idx (0..window-1).  Panels shorter than a window give no rows."""
    p = with_bounds(panel, by)
    pos = F.datediff("date", "_lo")
    n = F.datediff("_hi", "_lo") + 1
    lo = F.greatest(pos - (window - 1), F.lit(0))
    hi = F.least(pos, n - window)
    out = (p.filter(n >= window)
             .withColumn(SAMPLE_ID, F.explode(F.sequence(lo, hi)))
             .withColumn(DAY_IDX, pos - F.col(SAMPLE_ID)))
    return out.drop("_lo", "_hi")


def target_index(lookback: int, horizon: int, aggregation: str) -> int | None:
    """Position checked for a NULL target (first/last only)."""
    if aggregation == "first":
        return lookback
    if aggregation == "last":
        return lookback + horizon - 1
    return None


def sliding_windows(panel: DataFrame, lookback: int, horizon: int,
                    aggregation: str = "last", selling_at: str = "open",
                    by: Sequence[str] = ()) -> DataFrame:
    """Windows of lookback+horizon days per ticker, step one day.

    For first/last targets a window is skipped when the positional
    first/last horizon value of `selling_at` is NULL; for the other
    aggregations when every horizon value is NULL.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
    w = lookback + horizon
    t = target_index(lookback, horizon, aggregation)
    # whether the days around each day sell, from w - 1 before it to w - 1 after: a
    # window's start tells where in that list its horizon lies.  A ticker's series is
    # bounded by the calendar, and no copy of the windows is joined or shuffled
    around = Window.partitionBy(*by, "ticker").orderBy("date").rowsBetween(-(w - 1), w - 1)
    p = with_bounds(panel, by).withColumn("_sold", F.collect_list(F.col(selling_at).isNotNull()).over(around))
    long = window_positions(p, w, by)
    # place of the window's first day in the list
    first = F.col(SAMPLE_ID) - F.greatest(F.col(SAMPLE_ID) + F.col(DAY_IDX) - (w - 1), F.lit(0))
    if t is not None:
        valid = F.get("_sold", first + t)
    else:
        valid = F.exists(F.slice("_sold", first + lookback + 1, horizon), lambda x: x)
    return long.filter(valid).drop("_sold")


def sliding_windows_frame(panel: DataFrame, window: int, metric: str,
                          by: Sequence[str] = ()) -> DataFrame:
    """One row per window: `metric` values of the W days as an ordered array.

    Ordered frame over (by, ticker): a ticker's daily series has at most one
    row per calendar day, so a partition is bounded by the calendar length.
    """
    wspec = (Window.partitionBy(*by, "ticker").orderBy("date")
             .rowsBetween(Window.currentRow, window - 1))
    p = with_bounds(panel, by)
    out = (p.withColumn("_vals", F.collect_list(F.struct("date", F.col(metric).alias("v"))).over(wspec))
             .filter(F.size("_vals") == window)
             .select(*by, "ticker", F.datediff("date", "_lo").alias(SAMPLE_ID),
                     F.col("date").alias("start_date"),
                     F.transform("_vals", lambda s: s["v"]).alias("values")))
    return out


def lookback_horizon_split(long: DataFrame, lookback: int) -> tuple[DataFrame, DataFrame]:
    """x = day_idx < lookback, y = the rest."""
    return (long.filter(F.col(DAY_IDX) < lookback), long.filter(F.col(DAY_IDX) >= lookback))


def mask_last_day(long: DataFrame, lookback: int, features: Sequence[str]) -> DataFrame:
    """Set `features` NULL on the last look-back day (look-ahead guard)."""
    last = F.col(DAY_IDX) == lookback - 1
    return long.select(*[
        F.when(last, F.lit(None).cast(long.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in features else F.col(c) for c in long.columns])


def weekday_column(df: DataFrame, date_col: str = "date", out: str = "weekday") -> DataFrame:
    return df.withColumn(out, weekday_name(date_col))


# --- null-skipping positional aggregates (group-by form) -------------------

def first_non_null(value, order) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    return F.min_by(v, F.when(v.isNotNull(), o))


def last_non_null(value, order) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    return F.max_by(v, F.when(v.isNotNull(), o))


def agg_expr(value, how: str, order=DAY_IDX) -> Column:
    """first/last/mean/max/min of `value`, NULLs skipped (pandas groupby)."""
    v = F.col(value) if isinstance(value, str) else value
    if how == "first":
        return first_non_null(v, order)
    if how == "last":
        return last_non_null(v, order)
    if how == "mean":
        return F.avg(v)
    if how == "max":
        return F.max(v)
    if how == "min":
        return F.min(v)
    raise ValueError(f"unsupported aggregation {how}")


def horizon_target_agg(long: DataFrame, lookback: int, selling_at: str,
                       aggregation: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.when(F.col(DAY_IDX) >= lookback, F.col(selling_at))
    return long.groupBy(*by, "ticker", SAMPLE_ID).agg(agg_expr(y, aggregation).alias("sell_value"))


def return_exprs(lookback: int, buying_at: str, selling_at: str, aggregation: str) -> dict:
    """Aggregate expressions of the forward return inside one group-by."""
    x_buy = F.when(F.col(DAY_IDX) < lookback, F.col(buying_at))
    y_sell = F.when(F.col(DAY_IDX) >= lookback, F.col(selling_at))
    return {"buy_value": last_non_null(x_buy, DAY_IDX),
            "sell_value": agg_expr(y_sell, aggregation)}


def forward_return(long: DataFrame, lookback: int, buying_at: str = "open",
                   selling_at: str = "open", aggregation: str = "last",
                   by: Sequence[str] = ()) -> DataFrame:
    """Return of every window: aggregate of `selling_at` over the horizon /
    last non-null `buying_at` of the look-back - 1, keyed by (ticker,
    sample_id).  A zero or missing buy price gives NULL."""
    e = return_exprs(lookback, buying_at, selling_at, aggregation)
    g = long.groupBy(*by, "ticker", SAMPLE_ID).agg(*[v.alias(k) for k, v in e.items()])
    return g.select(*by, "ticker", SAMPLE_ID,
                    (safe_div("sell_value", "buy_value") - F.lit(1.0)).alias("return"))


def relative_scaling(long: DataFrame, features: Sequence[str], relative_to: str = "first",
                     by: Sequence[str] = (), lookback: int | None = None) -> DataFrame:
    """Every feature divided by its own first/last/min/max/mean inside the window
    (NULLs skipped).  With `lookback`, `long` holds whole windows: the reference is
    that of the look-back days alone and the horizon is scaled by it too.  Window
    partitions are single samples (<= W rows)."""
    part = Window.partitionBy(*by, "ticker", SAMPLE_ID)
    full = part.orderBy(DAY_IDX).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = {"first": (lambda c: F.first(c, ignorenulls=True), full), "last": (lambda c: F.last(c, ignorenulls=True), full),
            "mean": (F.avg, part), "max": (F.max, part), "min": (F.min, part)}
    if relative_to not in over:
        raise ValueError(f"unsupported relative_to {relative_to}")
    take, frame = over[relative_to]

    def reference(f: str) -> Column:
        return take(F.col(f) if lookback is None else F.when(F.col(DAY_IDX) < lookback, F.col(f))).over(frame)

    return long.withColumns({f: safe_div(F.col(f), reference(f)) for f in features})


def feature_project(long_x: DataFrame, params, by: Sequence[str] = ()) -> DataFrame:
    """The columns a sample is made of: its key, date, keyword counts (where the
    news are joined) and the numerical and textual features that `params` names."""
    wanted = list(dict.fromkeys([*by, SAMPLE_ID, "date", *[c for c in ("keywords_count",) if c in long_x.columns],
                                 *params.numerical_features, *params.textual_features, "ticker"]))
    missing = [c for c in wanted if c not in long_x.columns]
    if missing:
        raise ValueError(f"no column for the features {missing}")
    return long_x.select(*wanted)


def field_getter(name: str):
    """`transform` lambda reading one struct field (a one-argument lambda:
    PySpark passes the element index to two-argument lambdas)."""
    return lambda s: s[name]


def ordered_lists(fields: Sequence[str], order: str = DAY_IDX) -> Column:
    """Aggregate: one array of structs ordered by `order`, NULL fields kept."""
    return F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(f) for f in fields])))


def window_feature_lists(long_x: DataFrame, features: Sequence[str],
                         by: Sequence[str] = ()) -> DataFrame:
    """(ticker, sample_id) -> one list per feature in day order (NULLs kept)."""
    g = long_x.groupBy(*by, "ticker", SAMPLE_ID).agg(ordered_lists(features).alias("_rows"))
    return g.select(*by, "ticker", SAMPLE_ID,
                    *[F.transform("_rows", field_getter(f)).alias(f) for f in features])


def feature_target_join(lists: DataFrame, returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return lists.join(returns, on=[*by, "ticker", SAMPLE_ID], how="inner")
