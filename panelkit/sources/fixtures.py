"""Adapters from the driver's test tables to the library's input shapes.

No test table holds daily bars or dated news, so these derive them.  Each one
is a single aggregate / projection; the DuckDB oracle holds the same SELECT.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense bars: one ticker per event type, one bar per UTC day."""
    ev = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return (
        ev.groupBy(F.col("ts").cast("date").alias("date"),
                   F.col("event_type").alias("ticker"))
        .agg(F.min_by("value", "ts").alias("open"),
             F.max("value").alias("high"),
             F.min("value").alias("low"),
             F.max_by("value", "ts").alias("close"),
             F.max_by("value", "ts").alias("adj_close"),
             F.count(F.lit(1)).cast("double").alias("volume"))
    )


def _brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # part is a dimension keyed by p_partkey: the join is a plain equi join and
    # Catalyst broadcasts it when its statistics are under the threshold.
    return li.join(part, li.l_partkey == part.p_partkey)


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse bars: one ticker per part brand, one bar per ship date."""
    k = (F.col("l_orderkey") * F.lit(1000000.0) + F.col("l_linenumber") * F.lit(100000.0)
         + F.col("l_extendedprice") / F.lit(10.0))
    return (
        _brand_lines(spark, sf_dir)
        .withColumn("k", k)
        .groupBy(F.col("l_shipdate").cast("date").alias("date"),
                 F.col("p_brand").alias("ticker"))
        .agg(F.min_by("l_extendedprice", "k").alias("open"),
             F.max("l_extendedprice").alias("high"),
             F.min("l_extendedprice").alias("low"),
             F.max_by("l_extendedprice", "k").alias("close"),
             F.max_by("l_extendedprice", "k").alias("adj_close"),
             F.sum("l_quantity").alias("volume"))
    )


# The days that the test bars span, from the first one on.
FIRST_DAY, SPAN = "1995-01-02", 2498


def dated_news(spark: SparkSession, sf_dir: str, base: str = FIRST_DAY, days: int = SPAN, copies: int = 1) -> DataFrame:
    """News with a date, some null titles and null articles; with `copies`, every
    document is published on so many days."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    return d.select(
        F.date_add(F.lit(dt.date.fromisoformat(base)),
                   F.pmod(F.col("doc_id") * 37 + F.col("copy") * 419, F.lit(days)).cast("int")).alias("date"),
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string"), F.lit("/"), F.col("copy").cast("string")).alias("url"),
        F.col("source"),
        F.when(F.col("doc_id") % 97 == 5, F.lit(None).cast("string"))
        .otherwise(F.substring_index("text", "\n", 1))
        .alias("title"),
        F.when(F.col("doc_id") % 89 == 7, F.lit(None).cast("string"))
        .otherwise(F.col("text")).alias("article"),
        (F.col("doc_id") * copies + F.col("copy")).alias("ord"),
    )


def daily_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News on most days of the bars' span."""
    return dated_news(spark, sf_dir, copies=6)


def classed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a site with classed, nested blocks would serve them: attributes
    with `>` in them, numeric references, inner blocks, relative links."""
    h = F.replace(F.col("html"), F.lit("<article>"), F.concat(
        F.lit('<div class="teaser"><p>short of it</p></div><div title="a > b" class=\'lead article-content\'><p>n&#176; '),
        F.col("page_id").cast("string"),
        F.lit(" of the day&#8217;s<br/>list &amp;#38; more</p><blockquote><p>said &#x201C;so&quot;</p></blockquote>")))
    h = F.replace(h, F.lit("</article>"), F.lit("<p>end</div></div><p>outside"))
    n = F.col("page_id").cast("int")
    day = F.date_add(F.lit(dt.date(2023, 1, 1)), F.pmod(n * 37, F.lit(365)))
    clock = F.date_format(F.timestamp_seconds(F.pmod(n.cast("bigint") * 7919, F.lit(86400))), "HH:mm:ss")
    both = F.concat(day.cast("string"), F.lit("T"), clock)
    basic = F.translate(both, "-:", "")
    forms = [F.concat(both, F.lit("+00:00")), F.concat(both, F.lit("Z")), F.concat(both, F.lit("+05:30")), F.concat(both, F.lit(".1234567")),
             day.cast("string"), F.concat(both, F.lit("-0800")), F.lit("a while ago"), F.concat(basic, F.lit("Z")),
             F.concat(day.cast("string"), F.lit(" "), F.substring(clock, 1, 5)), F.concat(both, F.lit("+25:00"))]
    meta = F.concat(F.lit('<meta property="article:published_time" content="'),
                    F.element_at(F.array(*forms), F.pmod(n, F.lit(len(forms))) + 1), F.lit('"/></head>'))
    h = F.replace(h, F.lit("</head>"), F.when(n % 11 == 10, F.lit("</head>")).otherwise(meta))
    h = F.replace(h, F.lit('<li><a href="/'), F.lit('<li><a title="x > y" class="plain post-link" href="../a/./b?c=1&amp;d='))
    return table(spark, sf_dir, "pages").select("page_id", "url", h.alias("html"))


def event_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_news(spark, sf_dir, base="2024-01-01", days=30)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of orders per account, day, symbol and side."""
    lines = _brand_lines(spark, sf_dir)
    return (
        lines.groupBy(
            (F.col("l_suppkey") % 5).alias("account"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("p_brand").alias("symbol"),
            F.when(F.col("l_returnflag") == "R", F.lit("sell")).otherwise(F.lit("buy"))
            .alias("side"))
        .agg(F.sum("l_quantity").cast("bigint").alias("shares"))
    )


# Fixed values of the test fixtures: keywords (plain, so Java regex and RE2
# agree) and the three time frames used with brand_bars, which cover all of them.
FIXTURE_KEYWORDS = ("tion", "the", "que")
BRAND_FRAMES = frames(("train", "1995-01-01", "1999-12-31"),
                      ("val", "2000-01-01", "2000-12-31"),
                      ("test", "2001-01-01", "2001-12-31"))
EVENT_FRAMES = frames(("train", "2024-01-01", "2024-01-30"),
                      ("val", "2024-01-01", "2024-01-30"),
                      ("test", "2024-01-01", "2024-01-30"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """An adapter's result written once for a query that reads it several
    times (column pruning makes each use a different plan, so Spark would
    otherwise recompute the aggregation per use)."""
    from ..session import stage_table
    return stage_table(df, name)
