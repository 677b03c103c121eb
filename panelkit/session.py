"""Session helpers.

The library never creates a session inside an operator; callers pass one in.
`local_session` is for tests, the bench and the smoke entry.  On a cluster the
session comes from the platform and `checkpoint_dir` only reads what it set.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library expects (UTC dates, ANSI arithmetic,
# adaptive query execution for shuffle sizing and skew joins).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "panelkit") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    Read from `spark.checkpoint.dir`.  Where it is unset, a local session gets a
    fresh scratch folder; on a cluster a machine's own folder would lose what
    other executors write, so that is an error.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="panelkit-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for a written stage."""
    return os.path.join(checkpoint_dir(spark), name)


def stage_table(df, name: str):
    """Write `df` once as parquet under the shared checkpoint folder and read
    it back: cuts the lineage (a lost executor re-reads files instead of
    replaying the plan) with a single pass - `Dataset.checkpoint` computes
    an uncached plan twice (once to count, once to write)."""
    spark = df.sparkSession
    path = stage_path(spark, f"stage/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
