"""The shared folder for checkpoints and other intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _temporary_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"twinframe-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _temporary_folder(spark.sparkContext.applicationId)


_runs: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """The folder in the shared one that holds everything written since the start or the last release."""
    return _runs.setdefault(spark.sparkContext.applicationId, f"{shared_folder(spark)}/run-{uuid.uuid4().hex}")


# the folder of the innermost ``scratch_scope``
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the scope's folder, else in the run's, that nothing has used."""
    return f"{_scope.get() or run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, whether or not it fails.

    The function it gives writes a result outside, where it stays, and reads it back. Any other
    table made inside can't be read afterwards.
    """
    inner = new_folder(spark, "scope")
    entered = _scope.set(inner)

    def keep(result: DataFrame) -> DataFrame:
        return _written(result, f"{inner.rsplit('/', 1)[0]}/table-{uuid.uuid4().hex}")

    try:
        yield keep
    finally:
        _scope.reset(entered)
        _delete(spark, inner)


def release(spark: SparkSession) -> None:
    """Delete the run's folder; tables that are still read from it are lost, results written elsewhere are not."""
    folder = _runs.pop(spark.sparkContext.applicationId, None)
    if folder:
        _delete(spark, folder)


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It survives the loss of executors like a reliable checkpoint, and later reads of it are
    columnar and pruned.
    """
    return _written(df, new_folder(df.sparkSession, "table"))
