"""Writers and readers of the stage tables (news snapshots, datasets, prompts).

Every writer returns the table read back from storage, so a caller's next step
starts from files, not from the lineage that produced them.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.news import NEWS_SCHEMA
from ..operators.windows import with_bounds
from ..session import stage_path
from .versions import DatedStore


def unique_path(root: str, name: str) -> str:
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def news_snapshot_write(news: DataFrame, root: str) -> DataFrame:
    """A new version of the news store at `root` (`versions.DatedStore`), read back;
    the versions before it stay as backups."""
    return DatedStore(news.sparkSession, root).write(news)


def panel_table(panel: DataFrame, buckets: int | None = None) -> DataFrame:
    """The calendar panel stored bucketed by ticker and sorted by (ticker, date), one
    file a bucket, with its first and last day as columns: what groups or orders by
    ticker, or by ticker and more, then needs no exchange."""
    spark = panel.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"panel_{uuid.uuid4().hex[:12]}"
    (with_bounds(panel).repartition(buckets, "ticker").write.bucketBy(buckets, "ticker").sortBy("ticker", "date")
     .option("path", stage_path(spark, f"stage/{name}")).option("compression", "zstd").saveAsTable(name))
    return spark.table(name)


def news_csv_write(news: DataFrame, path: str) -> None:
    (news.select([f.name for f in NEWS_SCHEMA.fields]).write.mode("overwrite")
         .option("header", True).option("quoteAll", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(path))


def news_csv_read(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(NEWS_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write stands at `path` (its commit marker is there)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dataset_write(ds: DataFrame, root: str, key: str) -> DataFrame:
    """Write train/val/test once per `key` (what the dataset was made from: its
    inputs and parameters), partitioned by split.  A finished write of the key is
    kept and read; anything else there is replaced."""
    path = os.path.join(root, hashlib.sha256(key.encode()).hexdigest()[:16])
    if not is_complete(ds.sparkSession, path):
        ds.write.mode("overwrite").partitionBy("split").parquet(path)
    return ds.sparkSession.read.parquet(path)


PROMPT_SCHEMA = T.StructType([T.StructField("prompt", T.StringType()),
                              T.StructField("completion", T.StringType()),
                              T.StructField("index", T.StringType())])


def training_csv(prompts: DataFrame, path: str) -> DataFrame:
    """Prompt table as CSV (every field quoted; prompts hold newlines), read back."""
    (prompts.select("prompt", "completion", "index").write.mode("overwrite")
            .option("header", True).option("quoteAll", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path))
    return (prompts.sparkSession.read.schema(PROMPT_SCHEMA).option("header", True)
            .option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def training_jsonl(rows: DataFrame, path: str) -> DataFrame:
    """The prompt table (prompt, completion, index) as JSON lines, one record
    per row with NULL fields written, read back."""
    rows.select("prompt", "completion", "index").write.mode("overwrite") \
        .option("ignoreNullFields", False).json(path)
    return rows.sparkSession.read.schema(PROMPT_SCHEMA).json(path)
