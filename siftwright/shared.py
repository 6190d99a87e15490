"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes a query's shuffle files when it ends. What is written is read from its table, never from them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set by setCheckpointDir(); a local folder only where neither is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        path = tempfile.mkdtemp(prefix="siftwright-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


@contextmanager
def shuffles_gone(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run in here go with each query's end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write_once(df: DataFrame, path: str, mode: str = "errorifexists", partitions: tuple[str, ...] = (), **options: str) -> None:
    """Write df to path, with the writer's options, and let go of the shuffle files that made it."""
    with shuffles_gone(df.sparkSession):
        df.write.mode(mode).partitionBy(*partitions).options(**options).parquet(path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    Lineage ends here and survives lost executors: they cost no more than a re-read. Each call has a path of its own,
    removed by discard() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    write_once(df, path, **options)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    for paths in _SCOPES:
        paths.append(path)
    return table


#: Paths written in each scope that is open.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in here go at its end: for steps whose result is a table elsewhere."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES[:] = [own for own in _SCOPES if own is not paths]
        for path in paths:
            _forget(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for table in tables:
        _forget(table.sparkSession, table.scratch_path)
