"""Shared folders: where tables and models are written, and whether they are complete."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own, which goes when
    the program ends; on a cluster a machine-local folder would be invisible to the executors, so
    that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="oddsmith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        _local_dirs[context.applicationId] = folder
    return _local_dirs[context.applicationId]


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def is_complete(spark: SparkSession, path: str, marker: str = "_SUCCESS") -> bool:
    """Whether a finished write lies at ``path``."""
    files, folder = _hadoop_path(spark, f"{path}/{marker}")
    return files.exists(folder)


def folders_of(spark: SparkSession, path: str) -> list[str]:
    """The folders right below ``path``; none if there is no such path."""
    files, folder = _hadoop_path(spark, path)
    if not files.exists(folder):
        return []
    return [s.getPath().toString() for s in files.listStatus(folder) if s.isDirectory()]


def parameters_id(*parameters: object) -> str:
    """A name for what is made with the given parameters."""
    return hashlib.sha256("\n".join(map(repr, parameters)).encode()).hexdigest()[:16]


def identity(df: DataFrame, *parameters: object) -> str:
    """A name for what is derived from the files behind ``df`` with the given parameters.

    Writing a table anew gives its files new names, so a derived copy is not found again. Rows
    that come from no file are known by their plan.
    """
    source = sorted(df.inputFiles()) or [str(df.semanticHash())]
    named = "\n".join([*map(repr, parameters), *source])
    return hashlib.sha256(named.encode()).hexdigest()[:16]


def fingerprint(spark: SparkSession, path: str) -> str:
    """Name, length and time of a table's files, so that a derived copy can tell it is stale."""
    files, folder = _hadoop_path(spark, path)
    found = files.listStatus(folder)
    return ";".join(sorted(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}" for s in found))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a table and read back: computed once, and safe from lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside give their shuffle files back as soon as they end.

    For tables that are written once and then read from where they lie; otherwise the files stay
    until the driver happens to collect its garbage. Not for queries of several threads.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    files, folder = _hadoop_path(spark, path)
    files.delete(folder, True)
