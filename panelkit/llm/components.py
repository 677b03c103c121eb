"""Connected components of a link table by alternating star contractions.

Every round is two aggregations and two joins; the links never leave the
cluster.  A round's result is a written table in the shared checkpoint folder,
so lineage stays short and a lost executor re-reads files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")


def _large_star(e: DataFrame) -> DataFrame:
    s = _both_ways(e)
    low = s.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (s.join(low, "u").filter("v > u")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Edges are a < b: each b links its smaller neighbours to the smallest."""
    low = e.groupBy("b").agg(F.min("a").alias("m"))
    j = e.join(low, "b")
    return (j.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
                                       F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x"))
            .select("x.*").filter("a <> b").distinct())


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """`links` (a, b) of long ids -> (id, component): the smallest id reachable.

    Only ids that occur in a link between two different ids are returned.
    Repeated, reversed and self links are allowed; no links gives no rows.
    """
    e = stage_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a <> b").distinct(), name)

    def mark(d: DataFrame):
        return tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = mark(e)
    while before[0]:
        e = stage_table(_small_star(_large_star(e)), name)
        now = mark(e)
        if now == before:
            break
        before = now
    return (e.select(F.col("b").alias("id"), F.col("a").alias("component"))
            .unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()))
