"""The corpus pipeline: quality rules, line dedup, near-duplicate removal,
benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet and read again, so no stage recomputes another
and a lost executor re-reads files.  All but the last return the columns of
`documents`; the last returns the mix's word counts per document.

Every stage reads whole texts, however long.  A NULL or empty text fails the
quality rules; the other stages keep it (the mix takes no word of it).  Ids may be
NULL or repeated.  Further columns are carried along under any name, also those
that operators use themselves.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.op2_ngram_join import ngram_join
from panelkit.llm.op6_mixing import mix_sources
from panelkit.llm.op8_quality_rules import keep_good
from panelkit.llm.op9_line_templates import drop_recurring_lines
from panelkit.llm.op10_decontamination import drop_leaks
from panelkit.session import stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines under recurring templates go, in every document, and lines of twenty
    tokens in all texts but one; every document stays.  A template's documents
    are its distinct texts, so copies count once."""
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    out = drop_recurring_lines(packed).select(*[
        (F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key of every row's own, which its id need not be: an id may be NULL
    or stand on several texts.  Equal rows have equal keys."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")), key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the row of the least id
    stays, one without an id only where no other is; of rows repeated with id and
    text, one."""
    keyed, key = _keyed(docs)
    rows = stage_table(keyed, "pipeline-keyed")
    ids = rows.select("doc_id", "text", F.col(key).alias("key"))
    joined = ngram_join(ids, width=5, percent=80, id_col="key").select("key", "component_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    least = (ids.select("doc_id", "key").distinct().join(joined, "key")
             .groupBy("component_id").agg(F.min(rank).alias("least")).select(F.col("least.key").alias(key)))
    return rows.dropDuplicates([key]).join(least, key, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified benchmark passage go, whatever their id."""
    keyed, key = _keyed(docs)
    return drop_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

# Near duplicates and the BM25 search are not for SQL; tests/llm holds run()
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
