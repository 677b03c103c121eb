r"""`build_dataset`: bars + dated news -> labelled train/val/test samples.

Plan shape (one lazy DataFrame chain, `split` as a leading key throughout):

  bars --slice/split--> calendar_fill(split) --explode windows--> long rows
  news --split/keyword count--> candidates --top-k per date--> day lists  (broadcast: <= days rows)
                                            \--train days with > k--> window-day draws (ids only)
  long rows (+ day lists, + drawn titles as extra rows)
     --one hash group-by on (split, ticker, sample_id, replica)-->
  return, masked & scaled feature lists, title lists, filters
     --checkpoint--> train edges (one row) --> labels --> NULL guard (one tiny collect)

The windows group-by has exactly W (+ drawn titles) rows per key, so there is
no hot key; text only enters as the <= k selected titles per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_div, weekday_name
from ..operators import bars as B
from ..operators import news as N
from ..operators import targets as TG
from ..operators import titles as TT
from ..operators.util import frames_df, split_by_frames
from ..operators.windows import (DAY_IDX, SAMPLE_ID, agg_expr, return_exprs,
                                 target_index, window_positions)
from ..params import Params
from ..session import stage_table

WINDOW = ["split", "ticker", SAMPLE_ID]
KEYS = [*WINDOW, "replica"]


def prepare_bars(bars: DataFrame, params: Params, frames_tbl: DataFrame) -> DataFrame:
    b = B.nan_as_null(bars)
    if params.tickers is not None:
        b = b.filter(F.col("ticker").isin(list(params.tickers)))
    b = B.drop_incomplete_bars(b)           # melted store rows with a NULL are dropped
    if params.trading_on_weekend:
        b = B.weekend_ffill(b, min(f.start for f in params.frames), max(f.end for f in params.frames))
    return split_by_frames(b, frames_tbl)


def prepare_news(news: DataFrame, params: Params, frames_tbl: DataFrame) -> DataFrame:
    for f in params.frames:
        N.check_news_range(f.start, f.end)
    n = N.keyword_count(news, params.keywords, params.keywords_literal).drop("article")
    return split_by_frames(n, frames_tbl)


def samples(spark: SparkSession, bars: DataFrame, news: DataFrame, params: Params,
            title_filters: bool = True, materialize: bool = True) -> DataFrame:
    """Windows with returns, scaled lists and cut titles; no target yet.

    With `materialize`, the narrow inputs - the bars, the calendar panel (tickers
    x days), the title candidates (ids, counts, <= 1 title each; no article
    text) and the ids drawn - are checkpointed to the shared checkpoint folder, so the bar
    source and the article text are read once although several branches of
    the plan consume them."""
    L, H, W, k = params.lookback, params.horizon, params.window, params.max_titles_per_day
    train = params.train_split
    fr = frames_df(spark, params.frames)

    bars = prepare_bars(bars, params, fr)
    if materialize:
        bars = stage_table(bars, "bars")       # the calendar takes its bounds, tickers and days from it
    panel = B.calendar_fill(bars, by=["split"])
    if materialize:
        panel = stage_table(panel, "panel")
    long = window_positions(panel, W, by=["split"])
    # replicas of a training window differ in their drawn titles only, so they
    # are made for the draws and, after the group-by, for its one row a window
    replicas = F.explode(F.sequence(F.lit(0), F.when(F.col("split") == train, F.lit(max(1, params.replicas) - 1))
                                    .otherwise(F.lit(0))))

    # --- titles --------------------------------------------------------
    nws = prepare_news(news, params, fr)
    cand = TT.titles_nonzero(nws).select("split", "date", "ord", "title", "keywords_count")
    if materialize:
        cand = stage_table(cand, "title_candidates")
    counts = TT.day_counts(cand, by=["split"])
    # per-date lists: every evaluation day, and training days with k or fewer
    # candidates (the same list for every window) - one top-k pass for both
    fixed = cand.join(counts, ["split", "date"]) \
                .filter((F.col("split") != train) | (F.col("_m") <= k)).drop("_m")
    day_lists = TT.top_titles_per_day(fixed, k, by=["split"], counts=counts)
    # days with more than k training candidates: a NULL list.  A join and no union of
    # both kinds of days: a union of hash-dealt sides counts as dealt by that hash, and
    # where adaptive execution then cuts the sides unlike, the join with the windows fails
    sampled = (F.col("split") == train) & (F.col("_m") > k)
    day_lists = counts.join(day_lists, ["split", "date"], "left").select(
        "split", "date", "titles", sampled.alias("_draw"))

    x = long.filter(F.col(DAY_IDX) < L)
    window_days = x.select("split", "ticker", SAMPLE_ID, DAY_IDX, "date") \
                   .join(day_lists.filter("_draw").select("split", "date"), ["split", "date"], "left_semi") \
                   .withColumn("replica", replicas)
    group = ["split", "ticker", SAMPLE_ID, "replica", DAY_IDX]
    drawn = TT.sample_titles(window_days, cand.filter(F.col("split") == train), k, params.seed, group=group,
                             materialize=materialize)
    drawn_days = drawn.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(
        F.col(DAY_IDX).alias("d"), F.col("_rank").alias("r"), F.col("title").alias("t")))).alias("_d"))

    # --- one group-by per window --------------------------------------
    feats = list(params.numerical_features)
    drop = set(params.drop_features_for_last_day)
    last_day = F.col(DAY_IDX) == L - 1
    rows = long.join(day_lists.select("split", "date", F.col("titles").alias("_day_titles")),
                     ["split", "date"], "left")
    for f in feats:
        v = F.col(f).cast("double")
        if f in drop:
            v = F.when(last_day, F.lit(None).cast("double")).otherwise(v)
        rows = rows.withColumn(f"_m_{f}", F.when(F.col(DAY_IDX) < L, v))
    in_x = F.col(DAY_IDX) < L
    prices = list(dict.fromkeys([params.buying_at, params.selling_at]))
    rows = rows.select(*WINDOW, DAY_IDX, "date", *prices, *[f"_m_{f}" for f in feats], "_day_titles")

    t_idx = target_index(L, H, params.aggregation)
    sell_ok = F.col(params.selling_at).isNotNull()
    if t_idx is not None:
        valid = F.count_if((F.col(DAY_IDX) == t_idx) & sell_ok) > 0
    else:
        valid = F.count_if((F.col(DAY_IDX) >= L) & sell_ok) > 0
    rexp = return_exprs(L, params.buying_at, params.selling_at, params.aggregation)
    lookback_struct = F.when(in_x, F.struct(
        F.col(DAY_IDX).alias("_o"), F.col("date"),
        *[F.col(f"_m_{f}").alias(f) for f in feats], F.col("_day_titles").alias("titles")))
    g = rows.groupBy(*WINDOW).agg(
        valid.alias("_valid"),
        rexp["buy_value"].alias("_buy"), rexp["sell_value"].alias("_sell"),
        *[agg_expr(f"_m_{f}", params.relative_to).alias(f"_ref_{f}") for f in feats],
        F.array_sort(F.collect_list(lookback_struct)).alias("_x"),
    )
    g = (g.filter("_valid").withColumn("replica", replicas).join(drawn_days, KEYS, "left")
         .withColumn("_d", F.coalesce("_d", F.array().cast(drawn_days.schema["_d"].dataType))))

    def _scaled(f):
        return lambda s: safe_div(s[f], F.col(f"_ref_{f}"))

    def day_titles(s):
        drawn_today = F.transform(F.filter(F.col("_d"), lambda d: d["d"] == s["_o"]), lambda d: d["t"])
        return F.coalesce(s["titles"], drawn_today)

    out = g.select(
        *KEYS,
        F.transform("_x", lambda s: s["date"]).alias("date"),
        *[F.transform("_x", _scaled(f)).alias(f) for f in feats],
        F.transform("_x", lambda s: weekday_name(s["date"])).alias("weekday"),
        F.transform("_x", day_titles).alias("title"),
        (safe_div("_sell", "_buy") - F.lit(1.0)).alias("return"),
    )
    if not title_filters:
        return out
    out = TT.min_titles_filter(out, params.min_titles_per_window)
    return TT.last_day_titles_filter(out)


def label(samples_df: DataFrame, params: Params) -> DataFrame:
    """Bin edges from the training samples (after the title cut and
    replication), applied to every split."""
    train = samples_df.filter(F.col("split") == params.train_split)
    if params.strategy == "equal_frequency":
        edges = TG.equal_frequency_edges(train, params.num_bins)
    elif params.strategy == "equal_width":
        edges = TG.equal_width_edges(train, params.num_bins)
    else:
        raise ValueError(f"Unsupported binning strategy: {params.strategy}")
    return TG.apply_bins(samples_df, edges, params.labels)


def build_dataset(spark: SparkSession, bars: DataFrame, news: DataFrame, params: Params,
                  guard: bool = True, materialize: bool = True) -> DataFrame:
    """The whole preprocessing as one plan; with `guard`, the per-split NULL
    target check runs (one small collect) and NULL-target rows are dropped.

    `materialize` writes the samples as a stage table under the session's
    checkpoint folder, so edges, labels and the guard read them once instead
    of re-running the windows (and lost executors do not replay the lineage)."""
    s = samples(spark, bars, news, params)
    if materialize:
        s = stage_table(s, "samples")
    labelled = label(s, params)
    if guard:
        labelled = TG.null_target_guard(labelled, params.null_target_limit,
                                        splits=[f.split for f in params.frames])
    # titles decide which windows stay, whether or not they are a feature themselves
    return labelled.drop(*[c for c in ("title", "weekday") if c not in params.textual_features])
