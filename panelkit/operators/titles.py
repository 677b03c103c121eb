"""Per-day title selection: top-k for evaluation, weighted draws for training.

Selection runs per *date* (or per window-day for training draws) on narrow
rows (ids, counts); article text never travels through the window explosion.
Top-k is done in two stages - first inside (group, salt) buckets, then over
the at most `salt_buckets * k` survivors - so a day holding a large share of
all articles is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from ..session import stage_table
from .ranges import order_ranges


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          salt: Column | None = None, rank_col: str = "_rank") -> DataFrame:
    """Exact top-k rows per group by `order` (a total order), with rank 1..k.

    With `salt` (a per-row hash), the first pass keeps k rows per
    (group, salt bucket), as many buckets as the session has shuffle
    partitions, so a hot group is spread over all of them; the second pass
    ranks the survivors.
    """
    group = list(group)
    cur = df
    if salt is not None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cur = cur.withColumn("_salt", F.pmod(salt, F.lit(buckets)))
        w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
        cur = cur.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k) \
                 .drop("_r1", "_salt")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cur.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)


def titles_nonzero(news: DataFrame, count_col: str = "keywords_count") -> DataFrame:
    """Candidates: titled articles with a positive keyword count.

    NULL titles are not candidates (they carry no text; the reference would
    either emit 'nan' or fail when sorting them against strings)."""
    return news.filter((F.col(count_col) > 0) & F.col("title").isNotNull())


def day_counts(cand: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cand.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("_m"))


def top_titles_per_day(cand: DataFrame, k: int, by: Sequence[str] = (),
                       count_col: str = "keywords_count", order_col: str = "ord",
                       counts: DataFrame | None = None) -> DataFrame:
    """Evaluation pick per date: more than k candidates -> the k best by
    (count desc, title desc); k or fewer -> all, in their original order.

    Returns (by, date, titles ARRAY<STRING>), one row per date with a candidate.
    """
    grp = [*by, "date"]
    ranked = top_k(cand, grp, [F.col(count_col).desc(), F.col("title").desc(), F.col(order_col)],
                   k, salt=F.xxhash64(order_col))
    counts = day_counts(cand, by) if counts is None else counts
    # one row per date: bounded by the calendar, joined by key
    r = ranked.join(counts, grp)
    key = F.when(F.col("_m") <= k, F.col(order_col)).otherwise(F.col("_rank").cast("bigint"))
    g = r.groupBy(*grp).agg(F.array_sort(F.collect_list(F.struct(key.alias("_o"), F.col("title"))))
                            .alias("_t"))
    return g.select(*grp, F.transform("_t", lambda s: s["title"]).alias("titles"))


def sampling_key(seed: int, weight: Column, *ids) -> Column:
    """Efraimidis-Spirakis key -ln(u)/w: the k smallest keys are a weighted
    draw of k items without replacement, with u a repeatable hash uniform."""
    return -F.log(hash_uniform(seed, *ids)) / weight


def replicate_samples(df: DataFrame, n: int, col: str = "replica") -> DataFrame:
    """n copies of every row, numbered 0..n-1 (one row when n <= 1)."""
    n = max(1, int(n))
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def titles_per_window(title_col: str = "title") -> Column:
    return F.aggregate(F.transform(F.col(title_col), lambda d: F.size(d)), F.lit(0),
                       lambda acc, v: acc + v)


def min_titles_filter(df: DataFrame, m: int, title_col: str = "title") -> DataFrame:
    return df.filter(titles_per_window(title_col) >= m)


def last_day_titles_filter(df: DataFrame, title_col: str = "title") -> DataFrame:
    return df.filter(F.size(F.element_at(F.col(title_col), -1)) > 0)


def cut_titles_lists(df: DataFrame, k: int, is_train: bool, seed: int = 0,
                     keys: Sequence[str] = ("ticker", "sample_id")) -> DataFrame:
    """Title cut on already-built nested lists (title ARRAY<ARRAY<STRING>>,
    keywords_count ARRAY<ARRAY<INT>>), as in the reference's unit cases.

    Per day: NULL day -> []; zero counts dropped; more than k -> top-k by
    (count desc, title desc) for evaluation or a weighted draw for training.
    Array work inside the row - meant for already-small per-window lists."""
    day = F.arrays_zip(F.col("title").alias("t"), F.col("keywords_count").alias("c"))

    def per_day(pair, i):
        items = F.filter(F.arrays_zip(F.coalesce(pair["t"], F.array().cast("array<string>")).alias("t"),
                                      F.coalesce(pair["c"], F.array().cast("array<int>")).alias("c")),
                         lambda x: x["c"] > 0)
        if is_train:
            keyed = F.transform(items, lambda x: F.struct(
                (-F.log(hash_uniform(seed, *[F.col(c) for c in keys], i, x["t"]))
                 / F.log1p(x["c"].cast("double"))).alias("k"), x["t"].alias("t")))
            pick = F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["t"])
        else:
            keyed = F.transform(items, lambda x: F.struct((-x["c"]).alias("c"), x["t"].alias("t")))
            srt = F.array_sort(keyed, lambda a, b: F.when(a["c"] != b["c"], a["c"] - b["c"])
                               .otherwise(F.when(a["t"] > b["t"], -1).when(a["t"] < b["t"], 1).otherwise(0)))
            pick = F.transform(F.slice(srt, 1, k), lambda x: x["t"])
        return F.when(F.size(items) > k, pick).otherwise(F.transform(items, lambda x: x["t"]))

    return df.withColumn("title", F.transform(day, per_day))


def weight_intervals(cand: DataFrame, day_keys: Sequence[str], count_col: str = "keywords_count",
                     order_col: str = "ord", bucket: int = 100_000) -> DataFrame:
    """Per day, each candidate's [lo, hi) slice of the day's total weight
    W = sum ln(1 + count), in `order_col` order.  Prefix sums are two-level
    (ranges cut by splitters of the day's own order values, then rows inside a
    range) so no task holds a day of more than `bucket` candidates; range totals
    are taken from the same running sums, so consecutive slices meet exactly and
    tile [0, W)."""
    day_keys = list(day_keys)
    w = F.log1p(F.col(count_col).cast("double"))
    b = order_ranges(cand.select(*day_keys, order_col, w.alias("_w")), day_keys, order_col, bucket, "_rb")
    inner = Window.partitionBy(*day_keys, "_rb").orderBy(order_col)
    part = b.withColumn("_ps", F.sum("_w").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))) \
            .withColumn("_pp", F.coalesce(F.lag("_ps").over(inner), F.lit(0.0)))
    tot = part.groupBy(*day_keys, "_rb").agg(F.max("_ps").alias("_t"))   # last running sum of the range
    ow = Window.partitionBy(*day_keys).orderBy("_rb")
    off = tot.withColumn("_off", F.coalesce(F.sum("_t").over(ow.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0.0))) \
             .withColumn("_wsum", F.sum("_t").over(ow.rowsBetween(Window.unboundedPreceding,
                                                               Window.unboundedFollowing)))
    # off + _ps of the last row of a range equals the next range's off (same additions)
    j = part.join(off.select(*day_keys, "_rb", "_off", "_t", "_wsum"), [*day_keys, "_rb"])
    return j.select(*day_keys, order_col, "_w",
                    F.when(F.col("_pp") == 0, F.col("_off")).otherwise(F.col("_off") + F.col("_pp")).alias("_lo"),
                    F.when(F.col("_ps") == F.col("_t"), F.col("_off") + F.col("_t"))
                     .otherwise(F.col("_off") + F.col("_ps")).alias("_hi"),
                    "_wsum")


def sample_titles(window_days: DataFrame, cand: DataFrame, k: int, seed: int, group: Sequence[str],
                  day_keys: Sequence[str] = ("split", "date"), count_col: str = "keywords_count",
                  order_col: str = "ord", materialize: bool = True) -> DataFrame:
    """Training pick: per (window, replica, day) draw k candidates without
    replacement, p proportional to ln(1 + count) - successive sampling - as
    (group, day_keys, order_col, _rank, title), min(k, candidates) rows each.

    Drawing with replacement and passing over repeats is successive sampling.
    So every window-day makes 2k + 8 repeatable draws at once; a draw's slice of
    the day's weight axis is found by an equi-join on (day, bucket of the axis),
    each candidate standing in the buckets its slice overlaps; the first k
    different candidates stay.  Where the draws hold fewer (few candidates, or
    one with most of the weight), the rest is drawn from the candidates not yet
    picked by the k smallest keys -ln(u)/w, which continues the same law.  A
    draw that rounding puts past an edge is passed over like a repeat."""
    day_keys, group = list(day_keys), list(group)
    ids = list(dict.fromkeys([*group, *day_keys]))
    iv = weight_intervals(cand, day_keys, count_col, order_col)
    if materialize:
        iv = stage_table(iv, "weight_intervals")           # counted, dealt to buckets, and each day's total taken
    m = iv.groupBy(*day_keys).agg(F.count(F.lit(1)).alias("_m"))
    iv = iv.join(m, day_keys).withColumn("_d", F.col("_wsum") / F.col("_m"))
    last_b = F.col("_m") - 1
    reps = iv.select(*day_keys, order_col, "_lo", "_hi", F.explode(F.sequence(
        F.least(F.floor(F.col("_lo") / F.col("_d")), last_b).cast("long"),
        F.least(F.floor(F.col("_hi") / F.col("_d")), last_b).cast("long"))).alias("_b"))
    day_info = iv.select(*day_keys, "_wsum", "_d", "_m").distinct()
    # a window-day is a few bytes but many draws: dealt out by count, not by size
    parts = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_days = window_days.select(*ids).join(day_info, day_keys).repartition(parts, *ids)
    draws = (open_days.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(2 * k + 8))))
             .withColumn("_r", hash_uniform(seed, *group, F.col("_j")) * F.col("_wsum"))
             .withColumn("_b", F.least(F.floor(F.col("_r") / F.col("_d")), F.col("_m") - 1).cast("long")))
    hit = (draws.join(reps, [*day_keys, "_b"]).filter("_r >= _lo and _r < _hi")
           .groupBy(*ids, order_col).agg(F.min("_j").alias("_j")))
    picked = (hit.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_j")))
              .filter(F.col("_rank") <= k).select(*ids, order_col, "_rank"))
    if materialize:
        picked = stage_table(picked, "picked_titles")      # counted, passed over and returned
    got = picked.groupBy(*group).agg(F.count(F.lit(1)).alias("_got"))
    short = (open_days.join(got, group, "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
             .filter(F.col("_got") < F.least(F.lit(k), F.col("_m"))).select(*ids, "_got"))
    w = F.log1p(F.col(count_col).cast("double"))
    rest = (short.join(cand.select(*day_keys, order_col, count_col), day_keys)
            .join(picked.select(*group, order_col), [*group, order_col], "left_anti"))
    rest = (top_k(rest.withColumn("_key", sampling_key(seed, w, *group, order_col)), group,
                  [F.col("_key"), F.col(order_col)], k, salt=F.xxhash64(order_col), rank_col="_at")
            .withColumn("_rank", F.col("_got") + F.col("_at")).filter(F.col("_rank") <= k)
            .select(*ids, order_col, F.col("_rank").cast("int").alias("_rank")))
    return picked.unionByName(rest).join(cand.select(*day_keys, order_col, "title"), [*day_keys, order_col])
