"""Text helpers: paragraphs of an article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import word_count


def paragraph_split(df: DataFrame, id_col: str, text_col: str, min_words: int = 10) -> DataFrame:
    """One row per line-separated paragraph with more than `min_words` words;
    newlines inside become spaces."""
    p = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "p"))
    return (p.filter(word_count("p") > min_words)
             .select(id_col, "pos", F.replace("p", F.lit("\n"), F.lit(" ")).alias("paragraph")))
