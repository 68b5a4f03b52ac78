"""Shared scratch space for tables that cut lineage or are read back by a later step."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_roots: dict[str, str] = {}
_lock = threading.Lock()
_writers: list[str | None] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A temporary folder is used only by a local-mode session that sets none.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    application = context.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="lingospan-")
    return _local_roots[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the scratch root that no other call has used."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of a job at its end, for jobs whose result is written.

    The last of several writers at a time puts the setting of the session back.
    """
    with _lock:
        _writers.append(_writers[-1] if _writers else spark.conf.get(FREE_SHUFFLES, None))
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            before = _writers.pop()
            if not _writers:
                spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def store(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet, a folder for each value of the columns ``by``, and read it back.

    The table survives the loss of executors, is computed once however often it is read,
    and gives Catalyst the true size: joins broadcast it only when it is small. The shuffle
    files behind it are deleted when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_freed(spark):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a stored table that no frame in use reads any more."""
    files, jvm = df.inputFiles(), df.sparkSession.sparkContext._jvm
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of fewer splits than cores one hash partition per core.

    A large table has many splits and is returned as it is; a small file would otherwise
    leave all work after the scan to one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
