"""Input checks, date-string checks and NULL profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iso_date_check
from .util import one_row_join


def ticker_checks(asked: DataFrame, store: DataFrame) -> DataFrame:
    """Per asked ticker: is it in the store, and the store's date span for it."""
    st = store.groupBy("ticker").agg(F.min("date").alias("first_date"),
                                     F.max("date").alias("last_date"))
    return (asked.join(st, "ticker", "left")
                 .select("ticker", F.col("first_date").isNotNull().alias("is_known"),
                         "first_date", "last_date"))


def unknown_tickers(asked: DataFrame, store: DataFrame) -> DataFrame:
    """Asked tickers the store does not hold (the rows that fail a request)."""
    return asked.join(store.select("ticker").distinct(), "ticker", "left_anti")


def range_checks(asked: DataFrame, store: DataFrame) -> DataFrame:
    """Per asked (start, end): does it run forwards, does it meet the store's days,
    those days, and whether the request can be answered.  NULL bounds cannot."""
    span = store.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    forwards = F.coalesce(F.col("start") <= F.col("end"), F.lit(False))
    meets = F.coalesce((F.col("end") >= F.col("first_date")) & (F.col("start") <= F.col("last_date")), F.lit(False))
    return one_row_join(asked, span).withColumns(
        {"is_forwards": forwards, "overlaps_store": meets, "is_answerable": forwards & meets})


def date_parse_check(df: DataFrame, col: str) -> DataFrame:
    """Format check (regex only, so 2021-99-99 passes), parsed date (NULL when
    not a real date) and the date formatted back."""
    parsed = F.try_to_date(F.col(col), "yyyy-MM-dd")
    return df.select("*", iso_date_check(col).alias("format_ok"), parsed.alias("parsed"),
                     F.date_format(parsed, "yyyy-MM-dd").alias("formatted"))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, rows with no NULL, their difference, and NULLs per column (one pass)."""
    cols = df.columns
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    aggs = [F.count(F.lit(1)).alias("rows_before"), F.count_if(complete).alias("rows_after")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]
    return df.agg(*aggs).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))
