"""Target binning, NULL-target guard and time frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import grouped_quantiles
from .util import one_row_join


def equal_frequency_edges(train: DataFrame, q: int, value_col: str = "return") -> DataFrame:
    """One row `edges`: the q+1 linearly interpolated quantiles of the
    training values, duplicates dropped (pandas `qcut(..., duplicates='drop')`).
    Exact at every size, without gathering the column."""
    qs = distributed_quantiles(train, [i / q for i in range(q + 1)], value_col)
    return qs.select(F.array_distinct("q").alias("edges"))


def equal_width_edges(train: DataFrame, n: int, value_col: str = "return",
                      widen_first: bool = True) -> DataFrame:
    """One row `edges`: n equal-width bins from min to max; the first edge is
    lowered by 0.1 % of the range (pandas `cut`); when min == max both ends are
    widened by 0.1 % of the value (0.001 when it is 0)."""
    v = F.col(value_col)
    mm = train.agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    same = F.col("_mn") == F.col("_mx")
    if widen_first:
        mn = F.when(same, F.when(F.col("_mn") != 0, F.col("_mn") - F.lit(0.001) * F.abs("_mn"))
                    .otherwise(F.col("_mn") - F.lit(0.001))).otherwise(F.col("_mn"))
        mx = F.when(same, F.when(F.col("_mx") != 0, F.col("_mx") + F.lit(0.001) * F.abs("_mx"))
                    .otherwise(F.col("_mx") + F.lit(0.001))).otherwise(F.col("_mx"))
    else:
        mn, mx = F.col("_mn"), F.col("_mx")
    step = (mx - mn) / F.lit(float(n))
    edges = [mn + F.lit(float(i)) * step for i in range(n)] + [mx]
    if widen_first:
        adj = (F.col("_mx") - F.col("_mn")) * F.lit(0.001)
        edges[0] = F.when(same, edges[0]).otherwise(edges[0] - adj)
    return mm.select(F.when(F.col("_mn").isNull(), F.lit(None))
                     .otherwise(F.array(*edges)).alias("edges"))


def bin_index(value, edges) -> F.Column:
    """0-based index of the (a, b] interval holding the value, -1 outside.
    Not `Bucketizer`/`width_bucket`: those are left-closed."""
    v = F.col(value) if isinstance(value, str) else value
    e = F.col(edges) if isinstance(edges, str) else edges
    inside = (F.size(e) >= 2) & (v > F.element_at(e, 1)) & (v <= F.element_at(e, -1))
    return F.when(v.isNotNull() & ~F.isnan(v) & inside,
                  F.size(F.filter(e, lambda x: x < v)) - 1).otherwise(F.lit(-1))


def apply_bins(df: DataFrame, edges: DataFrame, labels: Sequence[str],
               value_col: str = "return", out: str = "target") -> DataFrame:
    """Label every row with the bin of its value (edges from a one-row table,
    e.g. computed on train and applied to train, val and test)."""
    lab = F.array(*[F.lit(x) for x in labels])
    joined = one_row_join(df, edges.select(F.col("edges").alias("_edges")))
    idx = bin_index(value_col, "_edges")
    return joined.withColumn(out, F.when(idx >= 0, F.element_at(lab, idx + 1))).drop("_edges")


def null_target_counts(df: DataFrame, split_col: str = "split", target: str = "target") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.count_if(F.col(target).isNull()).alias("n_null"))


def null_target_guard(df: DataFrame, limit: float = 0.05, split_col: str = "split",
                      target: str = "target", splits: Sequence[str] | None = None) -> DataFrame:
    """Per split: more than `limit` NULL targets fails; otherwise NULL rows are
    dropped.  One small aggregate is collected (a row per split)."""
    stats = {r[split_col]: (r["n_rows"], r["n_null"])
             for r in null_target_counts(df, split_col, target).collect()}
    for s in (splits or sorted(stats)):
        n, nn = stats.get(s, (0, 0))
        if n == 0:
            raise ValueError(f"{s}: no samples left")
        if nn > limit * n:
            raise ValueError(f"{s} target nulls: {nn}")
    return df.filter(F.col(target).isNotNull())


def time_frame_split(df: DataFrame, frames_tbl: DataFrame, date_col: str = "date") -> DataFrame:
    """Tag every row with each frame holding its date (frames may overlap)."""
    cond = (F.col(date_col) >= F.col("start")) & (F.col(date_col) <= F.col("end"))
    return df.join(F.broadcast(frames_tbl), cond).drop("start", "end")


def train_tail_frame(frames_tbl: DataFrame, train: str = "train", test: str = "test") -> DataFrame:
    """Evaluation range for train: max(end - test length, start) .. end."""
    t = frames_tbl.filter(F.col("split") == train).select("start", "end")
    tl = frames_tbl.filter(F.col("split") == test).select(
        F.datediff("end", "start").alias("_len"))
    return one_row_join(t, tl).select(
        F.greatest(F.date_sub("end", F.col("_len").cast("int")), F.col("start")).alias("start"),
        F.col("end"))


def return_histogram_by_target(df: DataFrame, bins: int = 50, value: str = "return",
                               target: str = "target") -> DataFrame:
    """Shared equal-width bins ([a, b), last closed) over all rows; percent of
    *all* rows per (target, bin)."""
    v = F.col(value)
    mm = df.agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"), F.count(F.lit(1)).alias("_tot"))
    j = one_row_join(df, mm)
    idx = F.when(F.col("_mx") == F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.floor((v - F.col("_mn")) / ((F.col("_mx") - F.col("_mn")) / F.lit(float(bins)))),
                F.lit(bins - 1)))
    g = j.groupBy(target, idx.cast("int").alias("bin"), "_tot").agg(F.count(F.lit(1)).alias("_n"))
    return g.select(target, "bin", (F.col("_n") * 100.0 / F.col("_tot")).alias("pct"))


def return_bin_target_freq(df: DataFrame, bins: int = 30, value: str = "return",
                           target: str = "target") -> DataFrame:
    """Counts per (a, b] equal-width bin (first edge lowered, pandas `cut`) and
    target, zero-filled over every bin x target seen."""
    v = F.col(value)
    mm = df.agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    j = one_row_join(df, mm)
    idx = F.when(v <= F.col("_mn"), F.lit(0)).otherwise(
        F.least(F.ceil((v - F.col("_mn")) / ((F.col("_mx") - F.col("_mn")) / F.lit(float(bins)))) - 1,
                F.lit(bins - 1)))
    counts = j.groupBy(target, idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    targets = df.select(target).distinct()
    grid = targets.select(target, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, [target, "bin"], "left").select(
        "bin", target, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def grouped_equal_frequency_edges(df: DataFrame, q: int, by: Sequence[str],
                                  value_col: str = "return") -> DataFrame:
    """Per group: q-quantile edges, duplicates dropped; exact, without a group's
    values in one buffer."""
    found = grouped_quantiles(df, [i / q for i in range(q + 1)], by, value_col)
    return found.select(*by, F.array_distinct("q").alias("edges"))


def grouped_equal_width_edges(df: DataFrame, n: int, by: Sequence[str],
                              value_col: str = "return") -> DataFrame:
    """Per group: plain linspace(min, max, n + 1) edges (no widening)."""
    v = F.col(value_col)
    g = df.groupBy(*by).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    step = (F.col("_mx") - F.col("_mn")) / F.lit(float(n))
    edges = [F.col("_mn") + F.lit(float(i)) * step for i in range(n)] + [F.col("_mx")]
    return g.select(*by, F.array(*edges).alias("edges"))


def distributed_quantiles(df: DataFrame, probs, value_col: str = "return", buckets: int = 128,
                          accuracy: int = 10_000) -> DataFrame:
    """Exact linearly interpolated quantiles without gathering the column.

    A sketch (`percentile_approx`) cuts the values into `buckets` equal-depth
    buckets; per-bucket counts (<= buckets rows) give each bucket's rank
    offset; only the buckets holding the needed ranks are opened, as
    (bucket, value, count) rows ranked by a window per bucket (~n/buckets
    distinct values each, ties collapsed).  Returns one row `q` with the
    quantiles in the order of `probs`.
    """
    from pyspark.sql import Window
    probs = [float(p) for p in probs]
    v = F.col("_v")
    base = df.select(F.col(value_col).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sk = base.agg(F.percentile_approx(v, cuts, accuracy).alias("_b"), F.count(F.lit(1)).alias("_n"))
    tagged = one_row_join(base, sk.select("_b")).select(
        "_v", F.size(F.filter("_b", lambda x: x < F.col("_v"))).alias("_bk"))
    cnt = tagged.groupBy("_bk").agg(F.count(F.lit(1)).alias("_c"))
    off = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))   # <= buckets rows
    # ranks needed: floor and ceil of (n - 1) * p for every p
    h = [(F.col("_n") - 1) * F.lit(p) for p in probs]
    ranks = sk.select("_n", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), hj.alias("h"))
                                                 for j, hj in enumerate(h)])).alias("_t"))
    ranks = ranks.select("_t.j", "_t.h", F.explode(F.array(F.floor("_t.h"), F.ceil("_t.h"))).alias("_r"))
    need = F.broadcast(ranks).join(
        F.broadcast(off), (F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_c")))
    opened = tagged.join(F.broadcast(need.select("_bk").distinct()), "_bk")
    dv = opened.groupBy("_bk", "_v").agg(F.count(F.lit(1)).alias("_vc"))
    cum = dv.withColumn("_end", F.sum("_vc").over(
        Window.partitionBy("_bk").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = need.join(cum, "_bk").filter(
        (F.col("_r") >= F.col("_off") + F.col("_end") - F.col("_vc")) & (F.col("_r") < F.col("_off") + F.col("_end")))
    lo_hi = at.groupBy("j", "h").agg(F.min_by("_v", "_r").alias("_lo"), F.max_by("_v", "_r").alias("_hi"))
    frac = F.col("h") - F.floor("h")
    qv = lo_hi.select("j", (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias("_q"))
    return qv.agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "_q"))), lambda s: s["_q"]).alias("q"))
