"""Ordering work without a single-task window: sorted ranges and offsets between them.

A running total or dense row number over a whole table is a window without partitions, i.e.
one task. Here the engine deals the rows out in key ranges and sorts each; numbers within a
range come from the sorted order, and the totals of earlier ranges (a small table) are added.
Where the cuts fall only decides balance: every result is exact for any cut. So the engine samples
and cuts by the beginnings of long texts, and whole keys are compared inside a range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinframe.sources.csv import ROW_INDEX
from twinframe.sources.scratch import cut_lineage

ROWS_PER_RANGE = 250_000
_COPIES_PER_PIECE = 100_000
# characters (or bytes) of a key column that the engine samples to place the cuts
KEY_LENGTH = 256
_IN_RANGE = 33  # bits of a growing id that count rows of one task


def _cut_key(df: DataFrame, order_by: list[str]) -> list[Column]:
    """Columns of bounded width that never contradict the order of the key.

    A text or binary value counts with its beginning, then whether it goes on. Rows whose value goes
    on aren't told apart further: they have NULL in the columns that follow, and so share a range.
    """
    cut, whole = [], F.lit(True)
    for name in order_by:
        kind, value = df.schema[name].dataType, F.col(f"`{name}`")
        if kind == T.StringType() or isinstance(kind, T.BinaryType):
            longer = F.coalesce(F.length(value) > KEY_LENGTH, F.lit(False))
            cut += [F.when(whole, F.substring(value, 1, KEY_LENGTH)), F.when(whole, longer)]
            whole = whole & ~longer
        else:
            cut.append(F.when(whole, value))
    return cut


def _sorted_ranges(rows: DataFrame, order_by: list[str], rows_per_range: int) -> DataFrame:
    """Rows with their range (``_range``), place in it (``_within``) and whether they repeat the key before (``_again``).

    Written, so that no place changes later. Equal keys lie in one range, next to each other.
    """
    ranges = max(1, -(-rows.count() // rows_per_range))
    names = [f"`{c}`" for c in order_by]
    cut = [c.alias(f"_cut{at}") for at, c in enumerate(_cut_key(rows, order_by))]
    cuts = [f"_cut{at}" for at in range(len(cut))]
    key = F.struct(*[F.col(n).alias(f"k{at}") for at, n in enumerate(names)])
    dealt = rows.select("*", *cut).repartitionByRange(ranges, *cuts)
    floating = any("float" in kind or "double" in kind for kind in (rows.schema[c].dataType.simpleString() for c in order_by))
    if floating:
        # a window by these columns groups normalized numbers: it would shuffle again and lose the ranges' order
        ordered = dealt.sortWithinPartitions(*names)
    else:
        # partitioned as the ranges are, so the window sorts each range and moves no row
        in_range = Window.partitionBy(*cuts).orderBy(*names)
        ordered = dealt.withColumn("_again", F.lag(key).over(in_range).eqNullSafe(key))
    placed = cut_lineage(ordered.drop(*cuts).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.select(
        *[f"`{c}`" for c in placed.columns[:-1]],
        F.shiftright("_place", _IN_RANGE).cast("int").alias("_range"),
        F.col("_place").bitwiseAND(F.lit((1 << _IN_RANGE) - 1)).alias("_within"),
    )
    if floating:
        in_range = Window.partitionBy("_range").orderBy("_within")
        placed = placed.withColumn("_again", F.lag(key).over(in_range).eqNullSafe(key))
    return placed


def _offsets(sizes: DataFrame) -> DataFrame:
    """Rows in earlier ranges, from (_range, _rows): one row per range."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))


def with_row_index(df: DataFrame, order_by: list[str], rows_per_range: int = 100_000) -> DataFrame:
    """Append the dense 0-based position of each row in the order of a unique key.

    NULL comes before all values of a key column and NaN after them. When the key names every
    column, rows with equal keys are copies of each other: they are counted, numbered as one
    group, and multiplied out again, so any number of copies is fine. Any other key must be
    unique: a key that occurs twice raises. Numbering sorts the table, so the result is written
    once and read from there.
    """
    if set(df.columns) <= set(order_by):
        return _index_copies(df, order_by, rows_per_range)
    placed = _sorted_ranges(df, order_by, rows_per_range)
    if not placed.where("_again").isEmpty():
        raise ValueError(f"the key {order_by} is not unique: name a unique key, or all columns")
    return _numbered(placed, df.columns)


def _numbered(placed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with the index of each placed row, written."""
    offsets = _offsets(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")))
    index = (F.col("_offset") + F.col("_within")).cast("bigint").alias(ROW_INDEX)
    return cut_lineage(placed.join(F.broadcast(offsets), "_range").select(*[f"`{c}`" for c in columns], index))


def _index_copies(rows: DataFrame, order_by: list[str], rows_per_range: int) -> DataFrame:
    names = [f"`{c}`" for c in rows.columns]
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    placed = _sorted_ranges(cut_lineage(groups), list(dict.fromkeys(order_by)), rows_per_range)
    if placed.where("_copies > 1").isEmpty():
        return _numbered(placed, rows.columns)
    offsets = _offsets(placed.groupBy("_range").agg(F.sum("_copies").alias("_rows")))
    before = Window.partitionBy("_range").orderBy("_within").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_offset") + F.coalesce(F.sum("_copies").over(before), F.lit(0))
    numbered = cut_lineage(placed.join(F.broadcast(offsets), "_range").withColumn("_first", first).drop("_range", "_offset", "_within", "_again"))

    def multiplied(pieces: DataFrame) -> DataFrame:
        steps = F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)
        return pieces.withColumn(ROW_INDEX, F.explode(steps)).select(*names, ROW_INDEX)

    # copies of a hot row are made by several tasks: cut them into pieces and spread those
    hot = F.col("_copies") > _COPIES_PER_PIECE
    starts = F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1, F.lit(_COPIES_PER_PIECE).cast("bigint"))
    pieces = (
        numbered.where(hot)
        .withColumn("_end", F.col("_first") + F.col("_copies"))
        .withColumn("_first", F.explode(starts))
        .withColumn("_copies", F.least(F.col("_end") - F.col("_first"), F.lit(_COPIES_PER_PIECE)))
        .drop("_end")
        .repartition("_first")
    )
    return multiplied(numbered.where(~hot)).unionAll(multiplied(pieces))
