"""Incremental collection by day as Structured Streaming.

New day files land in an incoming folder; the store takes only days it does not
hold yet.  A day's files may arrive over several micro-batches, so the stream
itself decides nothing about days:

* `ingest_new_days` writes each micro-batch to its own folder of an `arrived`
  table; a replayed micro-batch overwrites its folder, so nothing doubles.
* `commit_days` moves whole days into the store: the days the store held before
  this collection are written down once, all other arrived days overwrite their
  partition.  Run again after a failure, or after more files, it gives the same
  complete days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.stores import is_complete


def ingest_new_days(spark: SparkSession, incoming_dir: str, schema: T.StructType, arrived_path: str,
                    checkpoint_location: str, max_files_per_trigger: int | None = None):
    """Start (and return) a stream that copies the new files of `incoming_dir`
    to the arrived table; `availableNow` processes what is there and stops, a
    scheduler re-runs it when new days arrive."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{arrived_path}/batch={batch_id}")

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.parquet(incoming_dir).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True).start())


def commit_days(spark: SparkSession, arrived_path: str, store_path: str, base_path: str,
                partition_col: str = "date") -> DataFrame:
    """Add the arrived days the store did not hold when `base_path` was first
    written; returns the store read back."""
    if not is_complete(spark, base_path):
        spark.read.parquet(store_path).select(partition_col).distinct().write.mode("overwrite").parquet(base_path)
    arrived = spark.read.parquet(arrived_path).drop("batch")
    fresh = arrived.join(spark.read.parquet(base_path), partition_col, "left_anti")
    (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(store_path))
    return spark.read.parquet(store_path)
