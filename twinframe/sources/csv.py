"""CSV import of loosely typed tables and the three sinks."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinframe.functions.cells import clean_text
from twinframe.sources.records import file_records
from twinframe.sources.scratch import cut_lineage

ROW_INDEX = "row_idx"
BROKEN_ROW = "_broken_row"
# how a row is read, in the import and in the list of its errors
_OPTIONS = {
    "header": True,
    "escape": '"',
    "unescapedQuoteHandling": "RAISE_ERROR",
    "enforceSchema": False,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _header(spark: SparkSession, path: str, sep: str, multi_line: bool) -> list[str]:
    names = spark.read.csv(path, header=True, sep=sep, inferSchema=False, escape='"', multiLine=multi_line).columns
    # a line break inside a quoted name can hide that lines end in \r\n
    return [*names[:-1], names[-1].removesuffix("\r") or f"_c{len(names) - 1}"]


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether quotes go on over line breaks, from the numbers of quotes per line; an open one at a file's end raises."""
    lines = spark.read.text(path).select(
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
        F.col("_metadata.file_path").alias("file"),
    )
    files = lines.groupBy("file").agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("quotes") % 2 == 1).alias("odd"))
    odd, still_open = files.agg(F.coalesce(F.sum("odd"), F.lit(0)), F.count_if(F.col("quotes") % 2 == 1)).first()
    if still_open:
        raise ValueError(f"{path}: a quote is not closed")
    return odd > 0


def _stray(record: Column, sep: str) -> Column:
    """Whether a record has text behind a closing quote, or a line break outside quotes."""
    mark = re.escape(sep)
    # possessive, so that a long cell costs no stack
    cell = f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{mark}\n][^{mark}\n]*+|)'
    return F.contains(record, F.lit('"')) & ~record.rlike(f"^{cell}(?:{mark}{cell})*+$")


def _checked_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """The records of files with quoted line breaks; headers that differ between files raise."""
    records = cut_lineage(file_records(spark, path))
    headers = records.where("is_header").agg(F.min(F.lower("record")).alias("low"), F.max(F.lower("record")).alias("high")).first()
    if headers.low != headers.high:
        raise ValueError(f"{path}: headers differ between files: {headers.low!r}, {headers.high!r}")
    return records.where("NOT is_header").select("number", "record")


def _ddl(fields: list[T.StructField]) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in fields)


def _parsed(record: Column, fields: list[T.StructField], sep: str, mode: str) -> Column:
    options = {k: str(v) for k, v in _OPTIONS.items() if k not in ("header", "enforceSchema")}
    options |= {"sep": sep, "mode": mode, "multiLine": "true", "columnNameOfCorruptRecord": BROKEN_ROW}
    return F.from_csv(record, _ddl(fields), options)


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """Every column as text plus the row's file position; a malformed row or quote fails the import.

    Columns stay text because a single ``null`` or ``n/a`` token would make schema inference
    call a numeric column text. Line breaks inside quotes are read as part of the cell: a scan
    of the lines tells whether there are any, and only then records are put together from lines
    (``file_records``), also by many tasks a file. ``multi_line`` spares the scan when the answer
    is known; if it is true, one task reads a whole file, whose lines may then end in ``\\r`` alone.
    """
    spans = _spans_lines(spark, path) if multi_line is None else multi_line
    fields = [T.StructField(name, T.StringType()) for name in _header(spark, path, sep, spans)]
    if spans and multi_line is None:
        records = _checked_records(spark, path, sep)
        broken = F.raise_error(F.concat(F.lit("malformed row, unescaped quote: "), F.left("record", F.lit(200))))
        record = F.when(_stray(F.col("record"), sep), broken.cast("string")).otherwise(F.col("record"))
        # written whole, so that no pruned column hides a malformed row
        cells = cut_lineage(records.select(F.col("number").alias(ROW_INDEX), _parsed(record, fields, sep, "FAILFAST").alias("cells")))
        return cells.select(*[F.col("cells")[f.name].alias(f.name) for f in fields], ROW_INDEX)
    # a pruned scan would not notice malformed rows
    rows = spark.read.option("columnPruning", False).csv(
        path, schema=T.StructType(fields), mode="FAILFAST", **(_OPTIONS | {"multiLine": spans, "sep": sep})
    )
    return number_file_rows(rows)


def read_csv_errors(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The malformed rows of a CSV source, as parsed and as text in ``_broken_row``; none if ``read_csv`` takes it.

    The rows are read as in the import. A quote left open at a file's end makes its last row malformed. A row
    with text behind a closing quote comes without parsed cells. A lone quote inside an unquoted cell is taken
    to open one: the row is listed together with the lines up to the next lone quote or the end of its file.
    """
    try:
        spans = _spans_lines(spark, path)
    except ValueError:
        spans = True  # the open quote reaches to the end of its file
    fields = [T.StructField(name, T.StringType()) for name in _header(spark, path, sep, spans)]
    with_row = [*fields, T.StructField(BROKEN_ROW, T.StringType())]
    none = [F.lit(None).cast("string").alias(f.name) for f in fields]
    if spans:
        records = _checked_records(spark, path, sep).withColumn("stray", _stray(F.col("record"), sep))
        records = cut_lineage(records)
        cells = cut_lineage(records.where("NOT stray").select(_parsed(F.col("record"), with_row, sep, "PERMISSIVE").alias("cells")))
        broken = cells.select(*[F.col("cells")[f.name].alias(f.name) for f in with_row]).where(F.col(BROKEN_ROW).isNotNull())
        return broken.unionAll(records.where("stray").select(*none, F.col("record").alias(BROKEN_ROW)))
    options = _OPTIONS | {"unescapedQuoteHandling": "STOP_AT_DELIMITER", "sep": sep}
    rows = spark.read.option("columnPruning", False).csv(
        path, schema=T.StructType(with_row), mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN_ROW, **options
    )
    broken = rows.where(F.col(BROKEN_ROW).isNotNull() & ~_stray(F.col(BROKEN_ROW), sep))
    lines = spark.read.text(path).select(F.col("value").alias(BROKEN_ROW)).where(_stray(F.col(BROKEN_ROW), sep))
    return broken.unionAll(lines.select(*none, BROKEN_ROW))


def number_file_rows(rows: DataFrame) -> DataFrame:
    """Append the dense position of each row in (file, offset) order, without moving rows.

    One task reads a file split in file order, so ids that grow within a task give the place
    inside the split. What is left to add is the number of rows in earlier splits: a table of
    one row per split. The rows are written with their places, so a text source is read once.
    """
    columns = [f"`{c}`" for c in rows.columns]
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    )
    placed = cut_lineage(placed)
    splits = placed.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file",
        "_start",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(offsets, ["_file", "_start"])
        .select(*columns, (F.col("_place") + F.col("_shift")).alias(ROW_INDEX))
    )


def clean_cells(raw: DataFrame) -> DataFrame:
    """Turn missing-value tokens and empty cells into NULL in every text column."""
    return raw.select(
        *[
            clean_text(F.col(f"`{field.name}`")).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else F.col(f"`{field.name}`")
            for field in raw.schema
        ]
    )


def write_csv(table: DataFrame, folder: str) -> None:
    """A table as CSV part files with a header; NULL becomes an empty cell."""
    table.write.csv(folder, header=True, escape='"', emptyValue='""', nullValue="")


def write_text(lines: DataFrame, folder: str) -> None:
    """Report lines (``line_no``, ``line``) as one ordered text file: a few lines per column."""
    lines.orderBy("line_no").coalesce(1).select("line").write.text(folder)


def output_paths(folder: str, source: str) -> dict[str, str]:
    """Where the synthetic table, the text report and the summary of a source file go."""
    name = os.path.basename(source.rstrip("/"))
    stem = name.replace(".csv", "")
    return {
        "synthetic": f"{folder}/augmented_{name}",
        "report": f"{folder}/report_{stem}.txt",
        "summary": f"{folder}/stats_summary_{stem}.csv",
    }
