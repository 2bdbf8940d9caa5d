"""Cutting lineage so that the loss of an executor loses nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's file system delete ``path`` when the application ends, as long as it stands."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.

    Where none is set, a temporary one on a local master, as in tests; on a cluster, whose executors would each write to a
    disk of their own, this raises. Spark's folder in it is deleted when the application ends.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siktverk-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    folder = context._jsc.sc().getCheckpointDir().get()
    _delete_on_exit(spark, folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Steps:
    """The state of an iteration as a table in the checkpoint folder; each step replaces the one before.

    The last step stays as long as the application, as what was returned may still read it; :meth:`drop` deletes it at once.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{checkpoint_dir(spark)}/steps-{uuid.uuid4().hex}", 0

    def next(self, df: DataFrame) -> DataFrame:
        """Writes ``df``, which may read the step before, and drops that step."""
        path = f"{self.folder}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        if self.count:
            self._delete(f"{self.folder}/{self.count - 1}")
        else:
            _delete_on_exit(self.spark, self.folder)
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the table; nothing may read it any more."""
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
