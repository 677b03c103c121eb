"""Dated news operators: slice, keyword count, daily lists, incremental days."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import order_ranges, same_keys
from .util import as_date
from .windows import field_getter

NEWS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("article", T.StringType()),
])


def check_news_range(start, end) -> None:
    """News ranges need end strictly after start (prices allow equal)."""
    if not as_date(end) > as_date(start):
        raise ValueError("end_date must be after start_date")


def keyword_count(news: DataFrame, keywords: Sequence[str], literal: bool = False,
                  text_col: str = "article", out: str = "keywords_count") -> DataFrame:
    """Sum over keywords of non-overlapping, case-sensitive matches in the
    text; a NULL text counts as ''.  Keywords are regexes unless `literal`.

    The text is searched once a keyword: the sum is made by a generator of one
    value, as a filter on a projected sum would be pushed below it with a second
    copy of the whole expression.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if not keywords:
        return news.withColumn(out, F.lit(0))
    parts = [_matches(text, k, literal) for k in keywords]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return news.withColumn(out, F.explode(F.array(total.cast("int"))))


# What makes a keyword more than the characters it consists of.
REGEX_CHARACTERS = frozenset("\\^$.|?*+()[]{}")


def _matches(text: Column, keyword: str, literal: bool) -> Column:
    """Non-overlapping matches of one keyword.  One without regex characters is
    taken out of the text's bytes and the loss counted, without decoding the text
    or listing the matches."""
    if keyword and keyword.isascii() and (literal or not REGEX_CHARACTERS & set(keyword)):
        lost = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(keyword), F.lit("")))
        return (lost / F.lit(len(keyword))).cast("int")
    return F.regexp_count(text, F.lit(re.escape(keyword) if literal else keyword))


def relevant_flag(news: DataFrame, count_col: str = "keywords_count") -> DataFrame:
    return news.withColumn("is_relevant", F.col(count_col) > 0)


def news_slice(news: DataFrame, start, end, drop_articles: bool = False,
               keywords: Sequence[str] | None = None, literal: bool = False) -> DataFrame:
    """Inclusive date range; keywords are counted before the article is dropped."""
    check_news_range(start, end)
    out = news.filter(F.col("date").between(as_date(start), as_date(end)))
    if keywords is not None:
        out = keyword_count(out, keywords, literal)
    if drop_articles:
        out = out.drop("article")
    return out


def drop_untitled(news: DataFrame) -> DataFrame:
    return news.filter(F.col("title").isNotNull())


def rank_within(df: DataFrame, group: Sequence[str], order: str, bucket: int = 100_000,
                out: str = "pos") -> DataFrame:
    """0-based position of each row inside its group by the `order` column, without
    a window over a whole group: groups above `bucket` rows are cut into ranges by
    splitters of their own values (`order_ranges`), rows are counted per range, the
    counts of the earlier ranges are summed (a window over range counts) and a row
    number is taken inside each range."""
    group = list(group)
    b = order_ranges(df, group, order, bucket, "_b")
    per = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offs = per.select(*group, "_b", F.coalesce(before, F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(order))
    ranked = b.withColumn("_rn", rn)
    return (ranked.alias("x").join(offs.alias("y"), same_keys("x", "y", [*group, "_b"])).select("x.*", "y._off")
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint")).drop("_b", "_off", "_rn"))


def daily_news_positions(news: DataFrame, fields: Sequence[str] = ("title", "keywords_count"),
                         order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """Long form of the per-day lists: (date, pos, fields...), NULLs kept.  A day
    holding a large share of all articles is ranked in bounded ranges."""
    return rank_within(news.select(*by, "date", order, *fields), [*by, "date"], order) \
        .select(*by, "date", "pos", *fields)


def daily_news_lists(news: DataFrame, fields: Sequence[str] = ("title", "keywords_count"),
                     order: str = "ord", by: Sequence[str] = (), most: int = 10_000) -> DataFrame:
    """Per date: parallel lists of `fields` in `order`, NULL values kept, as
    (by, date, part, lists...).  A day is one row while it has at most `most`
    articles; a larger one continues in further parts of `most`, so no row or task
    grows with the day.  Lists of a day in order of part are the whole day's."""
    long = daily_news_positions(news, fields, order, by).withColumn("part", F.floor(F.col("pos") / most).cast("int"))
    g = long.groupBy(*by, "date", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_o"), *[F.col(f) for f in fields]))).alias("_rows"))
    return g.select(*by, "date", "part", *[F.transform("_rows", field_getter(f)).alias(f) for f in fields])


def daily_news_totals(news: DataFrame, count_col: str = "keywords_count", by: Sequence[str] = ()) -> DataFrame:
    """Per date: articles and keyword total (all that a price join needs of a day)."""
    return news.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("n_titles"), F.sum(count_col).cast("bigint").alias("kw"))


def missing_dates(news: DataFrame, start, end, spark: SparkSession | None = None) -> DataFrame:
    """Days in [start, end] with no stored row, newest first."""
    start, end = as_date(start), as_date(end)
    spark = spark or news.sparkSession
    days = spark.range(0, (end - start).days + 1).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    present = news.select("date").filter(F.col("date").between(start, end)).distinct()
    return days.join(present, "date", "left_anti").orderBy(F.col("date").desc())


def append_new_days(store: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Store plus the rows of days the store does not have yet (empty days
    carry no rows, so they stay missing and are retried next time)."""
    fresh = new_rows.join(store.select("date").distinct(), "date", "left_anti")
    return store.unionByName(fresh, allowMissingColumns=True)


def resume_point(store: DataFrame, default_start) -> DataFrame:
    """Next day to collect: last stored date + 1, or the default start."""
    return store.agg(F.coalesce(F.date_add(F.max("date"), 1),
                                F.lit(as_date(default_start))).alias("resume_date"))


def iso_timestamp(c) -> Column:
    """ISO-8601 text -> wall-clock time in UTC (TIMESTAMP_NTZ); NULL where it is none.

    Calendar dates in extended or basic form, alone (midnight) or with hours,
    minutes, seconds and a fraction (cut after microseconds), and an offset `Z`,
    +hh, +hhmm or +hh:mm; without one the time is UTC.  White space around it is
    ignored; week and ordinal dates are not read."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    shape = (r"^(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{4})([0-9]{2})([0-9]{2}))"
             r"(?:[Tt ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:[.,]([0-9]+))?)?)?)?"
             r" ?(?:([Zz])|([+-])([0-9]{2})(?::?([0-9]{2}))?)?$")

    def part(k: int) -> Column:
        return F.regexp_extract(text, shape, k)

    def number(*k: int) -> Column:
        digits = F.concat(*[part(x) for x in k])
        return F.when(digits == "", 0).otherwise(digits.cast("int"))

    second = F.concat(F.lpad(number(9).cast("string"), 2, "0"), F.lit("."), F.rpad(F.substring(part(10), 1, 6), 6, "0"))
    wall = F.try_make_timestamp_ntz(number(1, 4), number(2, 5), number(3, 6), number(7), number(8), second.cast("decimal(8,6)"))
    away = (number(13) * 60 + number(14)) * F.when(part(12) == "-", -1).otherwise(1)
    ok = text.rlike(shape) & (number(13) < 24) & (number(14) < 60) & (number(9) < 60)
    # a fraction is digits of the second, so the offset is whole minutes
    return F.when(ok, F.try_subtract(wall, F.make_dt_interval(mins=away)))


def published_time_local(df: DataFrame, ts_col: str, tz: str = "US/Eastern") -> DataFrame:
    """UTC publication time -> local time and the date in each zone.

    A string column is parsed as ISO-8601 (`iso_timestamp`; NULL when unparsable)."""
    c = F.col(ts_col)
    dtype = df.schema[ts_col].dataType
    if isinstance(dtype, T.StringType):
        c = iso_timestamp(c)
        dtype = T.TimestampNTZType()
    if isinstance(dtype, T.TimestampNTZType):
        # wall-clock UTC time: convert without the session time zone
        local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("time_utc"))
    else:
        local = F.from_utc_timestamp(F.col("time_utc"), tz)
    timed = df.drop(*[x for x in ("time_utc", "time_et", "date_utc", "date_et") if x != ts_col]).withColumn("time_utc", c)
    return timed.withColumn("time_et", local).withColumns({"date_utc": F.to_date("time_utc"), "date_et": F.to_date("time_et")})


def news_scan(spark: SparkSession, path: str | None, fmt: str = "parquet") -> DataFrame:
    """Load a news store; a missing store is an empty table with fixed columns."""
    if path is None:
        return spark.createDataFrame([], NEWS_SCHEMA)
    try:
        if fmt == "csv":
            return (spark.read.schema(NEWS_SCHEMA).option("header", True)
                    .option("multiLine", True).option("escape", '"').csv(path))
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], NEWS_SCHEMA)
        raise


def urls_per_day(news: DataFrame) -> DataFrame:
    return news.groupBy("date").agg(F.count("url").alias("n_urls"))


def articles_containing(news: DataFrame, word: str) -> DataFrame:
    """Number of non-null articles holding `word` as a plain substring."""
    return news.agg(F.count_if(F.col("article").contains(word)).alias("n_articles"))


def keyword_dimension(spark: SparkSession, ticker_keywords: dict) -> DataFrame:
    rows = [(t, k) for t, ks in ticker_keywords.items() for k in ks]
    return spark.createDataFrame(rows, "ticker string, keyword string")


def relevant_articles_by_ticker(news: DataFrame, ticker_keywords: dict,
                                literal: bool = False) -> DataFrame:
    """Per ticker: articles matching any of its keywords, ascending.

    One expression per ticker over a single scan of the text, then
    `unpivot` - no news x keyword cross join."""
    text = F.coalesce(F.col("article"), F.lit(""))
    flags = []
    for t, kws in ticker_keywords.items():
        pat = "|".join(re.escape(k) if literal else f"(?:{k})" for k in kws)
        flags.append(F.count_if(text.rlike(pat)).alias(t))
    wide = news.agg(*flags)
    long = wide.unpivot([], list(ticker_keywords), "ticker", "n_articles")
    return long.orderBy("n_articles", "ticker")


def keyword_volume_by_year(news: DataFrame, count_col: str = "keywords_count") -> DataFrame:
    return news.groupBy(F.year("date").alias("year")).agg(
        F.sum(count_col).cast("bigint").alias("keyword_volume"))


def keyword_volume_by_ticker_year(news: DataFrame, ticker_keywords: dict,
                                  literal: bool = False) -> DataFrame:
    """Per ticker and year: sum of that ticker's keyword counts.  One count
    expression per ticker over a single text scan, pre-aggregated per year,
    then unpivoted (no news x keyword cross join)."""
    text = F.coalesce(F.col("article"), F.lit(""))
    per_ticker = []
    for t, kws in ticker_keywords.items():
        parts = [F.regexp_count(text, F.lit(re.escape(k) if literal else k)) for k in kws]
        tot = parts[0]
        for p in parts[1:]:
            tot = tot + p
        per_ticker.append(F.sum(tot).cast("bigint").alias(t))
    wide = news.groupBy(F.year("date").alias("year")).agg(*per_ticker)
    return wide.unpivot(["year"], list(ticker_keywords), "ticker", "keyword_volume")
