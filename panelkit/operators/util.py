"""Small plan-building helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_date(v) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v))


def one_row_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row) to every row.

    The right side is a grand total (`df.agg(...)` without keys), so its size
    is one row by construction; the join is a broadcast of that single row.
    """
    return df.join(F.broadcast(one_row), F.lit(True), "inner")


def frames_df(spark, frames) -> DataFrame:
    return spark.createDataFrame(
        [(f.split, f.start, f.end) for f in frames], "split string, start date, end date")


def split_by_frames(df: DataFrame, frames_tbl: DataFrame, date_col: str = "date",
                    strict_end: bool = False) -> DataFrame:
    """Tag rows with every frame whose [start, end] holds the date.

    Frames may overlap (a row lands in several splits).  The frames table has
    one row per split (a handful), so the range join is a broadcast.
    """
    cond = (F.col(date_col) >= F.col("start")) & (F.col(date_col) <= F.col("end"))
    return df.join(F.broadcast(frames_tbl), cond).drop("start", "end")
