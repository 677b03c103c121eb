"""Cutting an order into ranges of about equal row counts, and exact quantiles
of many groups at once: both need no window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

CUTS = 256


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    """Equality of two aliases' keys, NULL equal to NULL; true without keys."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def order_ranges(df: DataFrame, group: Sequence[str], order: str, most: int = 100_000, out: str = "_range") -> DataFrame:
    """`df` with the number of each row's range in its group: groups of more than
    `most` rows are cut by splitters from a quantile sketch of their own order
    values, so ranges are even however sparse or uneven the values are.  Equal
    order values fall in one range; NULL values in the first."""
    group = list(group)
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*group)
    probs = F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)])
    cuts = (df.select(*group, order).alias("r").join(large.alias("l"), same_keys("r", "l", group), "left_semi")
            .groupBy(*group).agg(F.percentile_approx(order, probs, 8 * CUTS).alias("_cuts")))
    below = F.size(F.filter(F.array_distinct("_cuts"), lambda x: x < F.col(order)))
    return (df.alias("d").join(cuts.alias("c"), same_keys("d", "c", group), "left")
            .select("d.*", "c._cuts").withColumn(out, F.when(F.col("_cuts").isNull() | F.col(order).isNull(), 0)
                                                 .otherwise(below)).drop("_cuts"))


def grouped_quantiles(df: DataFrame, probs: Sequence[float], by: Sequence[str], value_col: str,
                      buckets: int = 128, accuracy: int = 4_096) -> DataFrame:
    """(by..., q): exact linearly interpolated quantiles of every group, in the
    order of `probs`; NULL and NaN values are left out, groups without others too.

    A sketch cuts each group's values into buckets; bucket counts (at most
    `buckets` rows a group) give rank offsets, and only buckets that hold a wanted
    rank are opened, as (value, count) rows.  No task holds a group's values."""
    by, probs, v = list(by), [float(p) for p in probs], F.col("_v")
    base = df.select(*by, F.col(value_col).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    base = stage_table(base, "quantile-values")
    cuts = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    sketch = base.groupBy(*by).agg(F.percentile_approx("_v", cuts, accuracy).alias("_cuts"), F.count(F.lit(1)).alias("_n"))
    tagged = (base.alias("b").join(sketch.alias("s"), same_keys("b", "s", by))
              .select("b.*", F.size(F.filter(F.array_distinct("s._cuts"), lambda x: x < F.col("b._v"))).alias("_bk")))
    values = tagged.groupBy(*by, "_bk", "_v").agg(F.count(F.lit(1)).alias("_c"))
    held = tagged.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    h = [(F.col("_n") - 1) * F.lit(p) for p in probs]
    ranks = (sketch.select(*by, F.explode(F.array(*[F.struct(F.lit(j).alias("j"), x.alias("h")) for j, x in enumerate(h)])).alias("t"))
             .select(*by, "t.j", "t.h", F.explode(F.array(F.floor("t.h"), F.ceil("t.h"))).alias("_r")))
    need = (ranks.alias("r").join(offset.alias("o"), same_keys("r", "o", by) & (F.col("r._r") >= F.col("o._off"))
                                  & (F.col("r._r") < F.col("o._off") + F.col("o._c")))
            .select("r.*", "o._bk", (F.col("r._r") - F.col("o._off")).alias("_at")))
    wanted = need.select(*by, "_bk").distinct()
    opened = values.alias("v").join(wanted.alias("w"), same_keys("v", "w", [*by, "_bk"]), "left_semi")
    upto = Window.partitionBy(*by, "_bk").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = opened.withColumn("_end", F.sum("_c").over(upto))
    at = (need.alias("n").join(ends.alias("e"), same_keys("n", "e", [*by, "_bk"]) & (F.col("n._at") < F.col("e._end"))
                               & (F.col("n._at") >= F.col("e._end") - F.col("e._c")))
          .select(*[F.col(f"n.{c}") for c in by], "n.j", "n.h", "n._r", F.col("e._v").alias("_v")))
    ends = at.groupBy(*by, "j", "h").agg(F.min_by("_v", "_r").alias("lo"), F.max_by("_v", "_r").alias("hi"))
    q = (F.col("lo") + (F.col("h") - F.floor("h")) * (F.col("hi") - F.col("lo"))).alias("q")
    return (ends.select(*by, "j", q).groupBy(*by)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "q"))), lambda s: s["q"]).alias("q")))
