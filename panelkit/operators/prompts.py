"""Sample row -> text prompt, completion and key (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import float_list_text, py_str_repr

# The prompt template of the reference (line texts and their
# 12-space indentation, trailing 4 spaces).
PAD = "\n            "
PROMPT_LINES = (
    ("Ticker: ", "ticker"),
    ("Weekdays: ", "weekday"),
    ("Stock Data:", None),
    ("- Open Prices: ", "open"),
    ("- Close Prices: ", "close"),
    ("- Adjusted Close Prices: ", "adj_close"),
    ("- High Prices: ", "high"),
    ("- Low Prices: ", "low"),
    ("- Volume: ", "volume"),
    ("News Titles:", None),
)
PROMPT_END = "Predict the expected stock return for the next day:\n    "


def sample_key(ticker="ticker", dates="date") -> Column:
    """`"{ticker} - {YYYY-MM-DD of the last day}"`."""
    t = F.col(ticker) if isinstance(ticker, str) else ticker
    d = F.col(dates) if isinstance(dates, str) else dates
    last = F.element_at(d, -1) if isinstance(dates, str) else d
    return F.concat(t, F.lit(" - "), F.date_format(last, "yyyy-MM-dd"))


def titles_block(title="title") -> Column:
    """One line per day: the Python repr of the day's title list ('' if none)."""
    day = lambda d: F.when(d.isNull(), F.lit("")).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform(d, py_str_repr), ", "), F.lit("]")))
    return F.array_join(F.transform(F.col(title), day), "\n")


def prompt_text(ticker="ticker") -> Column:
    parts = [F.lit("\n")]
    for i, (label, col) in enumerate(PROMPT_LINES):
        parts.append(F.lit(("" if i == 0 else PAD) + (" " * 12 if i == 0 else "") + label))
        if col == "ticker":
            parts.append(F.col(ticker))
        elif col == "weekday":
            parts.append(F.array_join(F.col("weekday"), ", "))
        elif col is not None:
            parts.append(float_list_text(col))
    parts += [F.lit(PAD), titles_block("title"), F.lit(PAD + PROMPT_END)]
    return F.concat(*parts)


def prompt_build(samples: DataFrame) -> DataFrame:
    """(index, prompt, completion) per sample; completion = target + newline."""
    return samples.select(
        sample_key().alias("index"),
        prompt_text().alias("prompt"),
        F.concat(F.col("target"), F.lit("\n")).alias("completion"))
