"""The registered queries of the numbered operators and their DuckDB SQL.

Each query reads its whole tables, applies one operator with production
parameters and derives plain columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_revisits, op4_tool_calls, op7_language, sql
from .op2_ngram_join import ngram_join
from .op3_suffix_dedup import remove_repeats
from .op5_token_counts import token_counts
from .op6_mixing import mix_sources
from .op8_quality_rules import quality_rules
from .op9_line_templates import drop_recurring_lines
from .op10_decontamination import find_leaks
from .op11_minhash import minhash_dedup
from .op12_whitening import whiten
from .op13_lexical_search import lexical_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    if fn.__name__ in sql.ORACLE:
        ORACLE[fn.__name__] = sql.ORACLE[fn.__name__]
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op1_revisits.resolve_revisits(op1_revisits.page_records(_table(spark, sf_dir, "pages")))
    return found.withColumn("headers", op1_revisits.header_text(F.col("headers")))


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), width=4, percent=85)


@_query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=400).drop("kept")


@_query
def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = op4_tool_calls.conversation_calls(_table(spark, sf_dir, "conversations"))
    return op4_tool_calls.link_tool_calls(calls, results, op4_tool_calls.SCHEMAS)


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                        split_at_space=True, limit=2048)


@_query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = op7_language.fit(docs, rest != 2)
    return op7_language.identify(docs, model, held_out=rest == 2)


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


@_query
def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


@_query
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_table(spark, sf_dir, "documents"), width=4, percent=80)


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=16)


@_query
def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=20)
