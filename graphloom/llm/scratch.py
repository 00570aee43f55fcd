"""Intermediate tables in the folder that the cluster shares.

An iterative or multi-pass operator writes what it needs again as Parquet under ``spark.checkpoint.dir``.
This cuts lineage (a lost executor costs a re-read, not a recomputation), and gives Catalyst the true
size of a table, so that it broadcasts a side only below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LIVE: list["Scratch"] = []
#: Bytes of a row group: a task holds one while it writes or reads.
ROW_GROUP = 16 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextlib.contextmanager
def _files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions that start here delete their shuffle files at their end, not at the driver's next garbage collection. A plan
    that is run for the files it writes is not run again, so nothing is computed twice."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


class Scratch:
    """Tables of one operator call. ``drop`` removes what is no longer needed; the rest goes at exit."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _LIVE.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of the files. The shuffles behind it go when they are written."""
        with _files_cleaned(self.spark):
            df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        _delete(self.spark, self.base)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _close_all() -> None:
    for one in _LIVE:
        try:
            one.close()
        except Exception:  # the JVM may be gone; the folder is then the cluster's to clean
            return


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row): texts may be long, and a worker holds a batch at once. All operators
    share this one value, and a session that has set its own keeps it."""
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
