"""A dated store whose commits are whole or not there.

    root/data/commit=<id>     the rows of a commit, ordered by day within each file
    root/manifests/<id>       (date, commit) of every day of a version
    root/versions/<number>    the id of the version's manifest

A commit writes its rows, then its manifest, and last the small version file,
which is created only if it is not there: readers take the greatest complete
version file, so they see the old state until that moment and the new one after
it, and of two writers that started from one version one fails.  What a stopped
commit has left is in no manifest and is never read.  Earlier versions stay
readable, as backups; days that a commit does not touch are not copied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer has committed since this one has read the store."""


class DatedStore:
    def __init__(self, spark: SparkSession, root: str, date_col: str = "date"):
        self.spark, self.root, self.date_col = spark, root.rstrip("/"), date_col
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---------------------------------------------------------

    def _listed(self) -> dict[int, str | None]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return {}
        out: dict[int, str | None] = {}
        for status in self._fs.listStatus(folder):
            name = status.getPath().getName()
            if not name.isdigit():
                continue
            stream = self._fs.open(status.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            # a writer that stopped within this file has left no line
            out[int(name)] = text[:-1] if text.endswith("\n") else None
        return out

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return sorted(n for n, commit in self._listed().items() if commit)

    def _point(self, number: int, commit: str) -> None:
        path = self._path(f"{self.root}/versions/{number:010d}")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:  # noqa: BLE001 - Hadoop raises a Java exception
            raise CommitConflict(f"version {number} of {self.root} is there already") from e
        try:
            stream.write(bytearray(f"{commit}\n".encode()))
        finally:
            stream.close()

    # --- reading ----------------------------------------------------------

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """(date, commit) of a version's days; None where there is no version."""
        listed = self._listed()
        whole = sorted(n for n, commit in listed.items() if commit)
        if version is None:
            if not whole:
                return None
            version = whole[-1]
        if not listed.get(version):
            raise ValueError(f"{self.root} has no version {version}")
        return self.spark.read.parquet(f"{self.root}/manifests/{listed[version]}")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the last one), or None where there is none."""
        days = self.manifest(version)
        if days is None:
            return None
        # one row a day; commits that gave no day of this version are not listed
        commits = [r["commit"] for r in days.select("commit").distinct().collect()]
        if not commits:
            # the version has no day, so only its columns are known
            commits = [self._listed()[self.versions()[-1] if version is None else version]]
        rows = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/commit={c}" for c in commits])
        same = (F.col("r.commit") == F.col("m.commit")) & F.col(f"r.{self.date_col}").eqNullSafe(F.col(f"m.{self.date_col}"))
        return rows.alias("r").join(days.alias("m"), same, "left_semi").drop("commit")

    # --- writing ----------------------------------------------------------

    def _commit(self, rows: DataFrame, kept: DataFrame | None, base: int) -> DataFrame:
        commit = uuid.uuid4().hex
        rows.sortWithinPartitions(self.date_col).write.mode("error").parquet(f"{self.root}/data/commit={commit}")
        written = (self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/commit={commit}")
                   .select(self.date_col).distinct().withColumn("commit", F.lit(commit)))
        days = written if kept is None else kept.select(self.date_col, "commit").unionByName(written)
        days.write.mode("error").parquet(f"{self.root}/manifests/{commit}")
        self._point(base + 1, commit)
        return self.read(base + 1)

    def _base(self) -> int:
        return max(self._listed(), default=0)

    def write(self, rows: DataFrame) -> DataFrame:
        """A version of these rows alone; the earlier ones stay as its backups."""
        return self._commit(rows, None, self._base())

    def append(self, rows: DataFrame) -> DataFrame:
        """A version with the days added that the store has not got.  Days without
        rows stay missing and can be appended later."""
        base = self._base()
        days = self.manifest()
        if days is None:
            return self._commit(rows, None, base)
        same = F.col(f"n.{self.date_col}").eqNullSafe(F.col(f"m.{self.date_col}"))
        fresh = rows.alias("n").join(days.alias("m"), same, "left_anti")
        return self._commit(fresh, days, base)
