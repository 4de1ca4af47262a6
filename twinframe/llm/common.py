"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.sources.scratch import cut_lineage  # noqa: F401  (the operators take it from here)

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_fold(column: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; NULL for a NULL id."""
    at = F.col(column) if isinstance(column, str) else column
    return F.crc32(at.cast("string").cast("binary")) % folds


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column's texts; a NULL counts as an empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


ROWS_AT_ONCE = 1000  # rows of an Arrow batch that are turned into Python objects together


def slices(batches: Batches, rows: int = ROWS_AT_ONCE) -> Batches:
    """Arrow batches in pieces of bounded row count, so that a task holds few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_batch(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Map slices of Arrow batches; ``make`` runs once per task and returns the function for one slice."""

    def run(batches: Batches) -> Batches:
        step = make()
        for batch in slices(batches):
            yield step(batch)

    return df.mapInArrow(run, schema)


def kept_in_worker(name: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once per Python worker and name and kept between tasks."""
    kept = sys.modules.setdefault("_twinframe_kept", types.ModuleType("_twinframe_kept")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
