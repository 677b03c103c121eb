"""Profiling aggregates behind the reference's exploration notebooks and plots.

Histograms are two passes over the data (bounds as a one-row aggregate, then
a bin index per row and a grouped count); rows are never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div, weekday_name, word_count
from ..session import stage_table
from .ranges import grouped_quantiles
from .util import one_row_join

METRICS = ("open", "high", "low", "close", "adj_close", "volume")
# English day names, Monday first (reference ordering).
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def week_end(c) -> F.Column:
    """Sunday that ends the Monday..Sunday week of the date (resample 'W')."""
    return F.date_add(F.date_trunc("week", F.col(c) if isinstance(c, str) else c).cast("date"), 6)


def weekly_availability(bars: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per ticker and week (labelled by its Sunday): 1 - NULL cells / (market
    days x metrics) over the wide store; weeks without market days are NULL."""
    metrics = [m for m in metrics if m in bars.columns]
    nulls = sum((F.col(m).isNull().cast("int") for m in metrics), F.lit(0))
    days = bars.select("date").distinct()
    wk = days.groupBy(week_end("date").alias("week_end")).agg(F.count(F.lit(1)).alias("n_days"))
    bounds = wk.agg(F.min("week_end").alias("_lo"), F.max("week_end").alias("_hi"))
    tickers = bars.select("ticker").distinct()
    grid = one_row_join(tickers, bounds).select(
        "ticker", F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 7 DAYS"))).alias("week_end"))
    pres = bars.groupBy("ticker", week_end("date").alias("week_end")).agg(
        F.count(F.lit(1)).alias("present"), F.sum(nulls).alias("nm"))
    n = len(metrics)
    j = grid.join(wk, "week_end", "left").join(pres, ["ticker", "week_end"], "left")
    miss = F.coalesce("nm", F.lit(0)) + F.lit(n) * (F.col("n_days") - F.coalesce("present", F.lit(0)))
    return j.select("ticker", "week_end",
                    (F.lit(1.0) - safe_div(miss.cast("double"), F.col("n_days") * n)).alias("availability"))


def equal_bins(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """numpy/seaborn histogram: `bins` equal bins over [min, max] of each
    group, [a, b) with the last bin closed.  Returns (by, bin, lo, hi, n)."""
    by = list(by)
    v = F.col(value)
    bounds = df.groupBy(*by).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    j = df.join(bounds, by) if by else one_row_join(df, bounds)
    width = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    idx = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.floor((v - F.col("_mn")) / width), F.lit(bins - 1)))
    g = j.filter(v.isNotNull()).groupBy(*by, idx.cast("int").alias("bin"), "_mn", "_mx") \
         .agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    return g.select(*by, "bin", (F.col("_mn") + F.col("bin") * w).alias("lo"),
                    (F.col("_mn") + (F.col("bin") + 1) * w).alias("hi"), "n")


def article_counts_by_period(news: DataFrame) -> DataFrame:
    """Counts per day / week (label Monday) / month / year over rows with no
    NULL in any column; one pass with a grain column."""
    clean = news.dropna(how="any")
    grains = F.array(
        F.struct(F.lit("day").alias("grain"), F.col("date").alias("period")),
        F.struct(F.lit("week").alias("grain"), F.date_trunc("week", "date").cast("date").alias("period")),
        F.struct(F.lit("month").alias("grain"), F.date_trunc("month", "date").cast("date").alias("period")),
        F.struct(F.lit("year").alias("grain"), F.date_trunc("year", "date").cast("date").alias("period")))
    return (clean.select(F.inline(grains))
                 .groupBy("grain", "period").agg(F.count(F.lit(1)).alias("n_articles")))


def daily_counts(news: DataFrame) -> DataFrame:
    return news.dropna(how="any").groupBy("date").agg(F.count(F.lit(1)).alias("daily_count"))


def source_distribution(news: DataFrame) -> DataFrame:
    """Count and percentage per source over complete rows."""
    g = news.dropna(how="any").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    tot = g.agg(F.sum("n").alias("_tot"))
    return one_row_join(g, tot).select("source", "n", (F.col("n") * 100.0 / F.col("_tot")).alias("pct"))


def word_count_averages(news: DataFrame) -> DataFrame:
    """Truncated mean whitespace-token counts of titles and articles."""
    clean = news.dropna(how="any")
    return clean.agg(F.avg(word_count("title")).cast("int").alias("avg_title_words"),
                     F.avg(word_count("article")).cast("int").alias("avg_article_words"))


def word_counts_by_weekday(news: DataFrame, spark=None) -> DataFrame:
    """Mean title/article words per weekday, all seven days (NULL if absent)."""
    clean = news.dropna(how="any")
    g = clean.groupBy(weekday_name("date").alias("weekday")).agg(
        F.avg(word_count("title")).alias("avg_title_words"),
        F.avg(word_count("article")).alias("avg_article_words"))
    spark = spark or news.sparkSession
    days = spark.createDataFrame([(d, i) for i, d in enumerate(WEEKDAYS)], "weekday string, day_no int")
    return F.broadcast(days).join(g, "weekday", "left")


def titles_per_window_histogram(samples: DataFrame, bins: int = 10) -> DataFrame:
    from .titles import titles_per_window
    counts = stage_table(samples.select(titles_per_window("title").alias("n_titles")), "n_titles")
    return equal_bins(counts, "n_titles", bins)        # bounds and bins both read it


def nearest_vector(vectors: DataFrame, query_id: int, id_col: str = "vec_id",
                   vec_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """Best cosine match for the vector with id `query_id`; smallest id on ties.

    The query vector is a one-row aggregate attached to every row; the best
    match is a global `max` of (similarity, -id), combined map-side, so the
    scan is linear and nothing is collected."""
    from ..functions.columns import cosine
    q = (vectors.filter(F.col(id_col) == query_id)
         .agg(F.max_by(F.col(vec_col).cast("array<double>"), F.col(id_col)).alias("_q")))
    v = vectors.select(F.col(id_col).alias("match_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    if exclude_self:
        v = v.filter(F.col("match_id") != query_id)
    scored = one_row_join(v, q).select("match_id", cosine("_v", "_q").alias("sim"))
    key = F.struct(F.col("sim"), (-F.col("match_id")).alias("neg_id"))
    best = scored.agg(F.max(key).alias("_b"))
    return best.select(F.lit(query_id).cast("bigint").alias("query_id"),
                       (-F.col("_b.neg_id")).alias("match_id"), F.col("_b.sim").alias("sim"))


BLOCK_BYTES = 32 << 20   # vectors that one search task holds
QUERY_BYTES = 8 << 20    # queries that one search task holds
DIGITS = 12              # similarities equal to so many digits are ties


def _best_in_cell(k: int, exclude_self: bool):
    """The k best vectors of a cell for each of its queries."""
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        def unit(t: pa.Table) -> np.ndarray:
            m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            return m / np.sqrt((m * m).sum(axis=1))[:, None]

        if not len(queries) or not len(vectors):       # a cell with one side only
            return pa.table({"query_id": pa.array([], pa.int64()), "match_id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        q_id, v_id = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
        order = np.argsort(v_id, kind="stable")
        v_id, side = v_id[order], unit(vectors)[order]
        found: list[tuple] = []
        ask = unit(queries)
        for at in range(0, len(ask), 256):
            sim = np.round(ask[at:at + 256] @ side.T, DIGITS)
            for row, q in zip(sim, q_id[at:at + 256], strict=True):
                if exclude_self:
                    row = np.where(v_id == q, -np.inf, row)
                # ids ascend, so a stable order breaks ties by the smaller id
                if len(row) > 4 * k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    near = np.flatnonzero(row >= least)
                else:
                    near = np.arange(len(row))
                near = near[np.argsort(-row[near], kind="stable")][:k]
                found += [(int(q), int(v_id[j]), float(row[j])) for j in near if row[j] > -np.inf]
        cols = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.table({c: pa.array(x, t) for c, x, t in zip(
            ("query_id", "match_id", "sim"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
    return run


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int = 1, id_col: str = "vec_id",
                    vec_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, match_id, sim): the k vectors of greatest cosine with each
    query, ties (equal to DIGITS digits) by the smaller id.

    A blocked similarity join: queries and vectors are dealt to cells of bounded
    bytes, a cell multiplies its two blocks and keeps k rows a query, and the
    cells' best are merged; no pair table exists.  Only vectors of a query's own
    length meet it.  Rows with a NULL id, a NULL, empty, zero or non-finite vector
    take no part; of an id's several rows each searches or is found."""
    from pyspark.sql import Window
    spark = vectors.sparkSession
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)

    def clean(df: DataFrame, name: str) -> DataFrame:
        d = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(sound)
        return stage_table(d.withColumn("width", F.size("v")), name)

    ask, side = clean(queries, "nearest-queries"), clean(vectors, "nearest-vectors")

    def blocks(d: DataFrame, most: int, name: str) -> DataFrame:
        return d.groupBy("width").agg(F.count(F.lit(1)).alias("n")).select(
            "width", F.ceil(F.col("n") * F.col("width") * 8 / F.lit(most)).cast("int").alias(name))

    # at least as many cells as the session has shuffle partitions
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = (blocks(ask, QUERY_BYTES, "qs").join(blocks(side, BLOCK_BYTES, "vs"), "width")
            .withColumn("vs", F.greatest("vs", F.ceil(F.lit(few) / F.col("qs")).cast("int"))))
    dealt = (ask.join(size, "width").select("width", F.pmod(F.xxhash64("id"), F.col("qs")).cast("int").alias("qb"),
                                            F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vb"), "id", "v"))
    held = (side.join(size, "width").select("width", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"),
                                            F.pmod(F.xxhash64("id"), F.col("vs")).cast("int").alias("vb"), "id", "v"))
    cell = ["width", "qb", "vb"]
    best = (dealt.groupBy(*cell).cogroup(held.groupBy(*cell))
            .applyInArrow(_best_in_cell(k, exclude_self), "query_id bigint, match_id bigint, sim double"))
    # at most k rows a cell and query meet here
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "match_id")
    ranked = best.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "match_id", "sim")


def group_percent(hist: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Percent of each bin inside its group (groups hold at most `bins` rows)."""
    from pyspark.sql import Window
    return hist.withColumn("pct", F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(*by)))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """min, quartiles (linear interpolation) and max per group."""
    q = grouped_quantiles(df, (0.0, 0.25, 0.5, 0.75, 1.0), by, value)
    return q.select(*by, *[F.col("q")[k].alias(c) for k, c in enumerate(("min", "q1", "median", "q3", "max"))])
