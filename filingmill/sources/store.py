"""Session helpers: Arrow batches of texts, and intermediate tables in the folder that driver and executors share.

A step whose rows are used more than once is written there and read back, so that it runs once and a lost
executor does not repeat it. The tables are deleted when the application ends, or with ``scratch``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of text that one Arrow batch holds; bounds a Python worker's memory.
BATCH_ROWS = 512
_watched: list[list[str]] = []


def small_batches(spark: SparkSession) -> None:
    """Long texts make large batches: lowers the session's Arrow batch to BATCH_ROWS rows, where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, and only if driver and executors are one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def _at(spark: SparkSession, path: str):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """A written path goes when the application ends."""
    files, target = _at(spark, path)
    files.deleteOnExit(target)


def written(df: DataFrame, name: str) -> str:
    """Where the rows were written; the table goes when the application ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it does not exist."""
    files, target = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target) if f.isDirectory()] if files.exists(target) else []


def stored(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write once, read back; the table goes when the application ends, or with ``scratch`` unless it is a ``result``."""
    path = written(df, name)
    for paths in _watched if not result else ():
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables stored inside; results that need them must be written by then."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield
    finally:
        _watched.remove(paths)
        for path in paths:
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder (iterations)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
