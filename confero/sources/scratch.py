"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where the session names none, a local session (tests) gets a temporary folder of its own;
    a cluster without the setting is refused, for its executors share no local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _OWN
    if _OWN is None:
        _OWN = "file://" + tempfile.mkdtemp(prefix="confero-")
    return _OWN


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder so that a lost
    executor costs a re-read and not a re-computation.  What a result still reads stays until the driver ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/confero/{what}-{uuid.uuid4().hex}"
        files, path = self._files(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read again: cuts the lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        files, path = self._files(self.path(name))
        files.delete(path, True)
