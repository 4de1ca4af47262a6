"""Records of CSV files whose quotes go on over line breaks, read by many tasks.

Whether a line begins a record depends on all quotes before it in its file. Each task counts
quotes inside the slices of files that it reads, and notes for every line what would hold if the
slice began outside a quote (0) and if it began inside one (1). One row per slice then tells,
from the parity of all earlier slices, which of the two is true. A line that is a record of its
own stays where it is; only the lines of longer records are shuffled, by the record's first line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.sources.scratch import cut_lineage

_LINE = "file string, start long, place long, value string, blank boolean, odd int, side int, at0 long, at1 long, c0 long, c1 long"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line: place in its slice, parity of its quotes and of those before it (``side``), and for both
    parities h the place of the last line with ``side`` h (``at``) and the number of such lines that aren't blank (``c``)."""
    now, side, place, at, c = None, 0, 0, [-1, -1], [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("file").dictionary_encode().indices.to_numpy()
        begin = batch.column("start").to_numpy()
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (begin[1:] != begin[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(low, high - low)
            slice_of = (part.column("file")[0].as_py(), int(begin[low]))
            if slice_of != now:
                now, side, place, at, c = slice_of, 0, 0, [-1, -1], [0, 0]
            value = part.column("value")
            odd = pc.count_substring(value, '"').to_numpy() & 1
            blank = pc.is_in(value, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            upto = side + np.cumsum(odd)
            sides = (upto - odd) & 1
            places = place + np.arange(len(odd))
            ats, counts = [], []
            for h in (0, 1):
                ats.append(np.maximum(np.maximum.accumulate(np.where(sides == h, places, -1)), at[h]))
                counts.append(c[h] + np.cumsum((sides == h) & ~blank))
                at[h], c[h] = int(ats[h][-1]), int(counts[h][-1])
            side, place = int(upto[-1] & 1), int(places[-1]) + 1
            columns = [part.column("file"), part.column("start"), places, value, blank, odd.astype(np.int32), sides.astype(np.int32), *ats, *counts]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[f.split()[0] for f in _LINE.split(", ")])


def _true_side(slices: DataFrame) -> DataFrame:
    """Per slice: the parity it begins with, the record that is open there, and how many records precede it."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = slices.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    at, count = (F.when(F.col("inside") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1")) for x in ("at", "c"))
    known = known.select("file", "start", "inside", at.alias("at"), count.alias("records"))
    open_record = F.last(F.when(F.col("at") >= 0, F.struct("start", F.col("at").alias("place"))), ignorenulls=True).over(earlier)
    first = (F.col("records") > 0) & (F.coalesce(F.sum("records").over(earlier), F.lit(0)) == 0)
    known = known.select("file", "start", "inside", "records", open_record.alias("open"), first.alias("has_header"))
    all_earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, 0)
    number = F.coalesce(F.sum("records").over(all_earlier), F.lit(0)) - F.sum(F.col("has_header").cast("long")).over(upto)
    return known.select("file", "start", "inside", "open", "has_header", number.alias("before"))


def file_records(spark: SparkSession, path: str) -> DataFrame:
    """file, is_header, number, record: every record that isn't an empty line, numbered from 0 in (file, offset) order without headers.

    A record ends at a line break (``\\n`` or ``\\r\\n``) outside quotes; those inside are kept as they
    are. The first record of a file is its header. A quote left open reaches to the end of its file.
    """
    text = spark.read.text(path, lineSep="\n")
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = cut_lineage(text.mapInArrow(_marked, _LINE))
    totals = {x: F.max(x).alias(x) for x in ("at0", "at1", "c0", "c1")}
    slices = cut_lineage(_true_side(lines.groupBy("file", "start").agg(F.sum("odd").alias("odd"), *totals.values())))
    begins = F.col("side") == F.col("inside")
    at, count = (F.when(F.col("inside") == 0, F.col(f"{x}0")).otherwise(F.col(f"{x}1")) for x in ("at", "c"))
    lines = lines.join(slices, ["file", "start"]).select(
        "file",
        "start",
        "place",
        "value",
        "blank",
        begins.alias("begins"),
        (begins & (F.col("odd") == 0)).alias("alone"),
        F.when(at >= 0, F.struct("start", at.alias("place"))).otherwise(F.col("open")).alias("head"),
        (F.col("has_header") & (count == 1)).alias("is_header"),
        (F.col("before") + count - 1).alias("number"),
    )
    alone = lines.where("alone AND NOT blank").select("file", "is_header", "number", F.col("value").alias("record"))
    in_order = F.array_sort(F.collect_list(F.struct("start", "place", "value")))
    longer = lines.where("NOT alone").groupBy("file", "head").agg(
        F.max(F.when(F.col("begins"), F.col("is_header"))).alias("is_header"),
        F.max(F.when(F.col("begins"), F.col("number"))).alias("number"),
        F.array_join(F.transform(in_order, lambda x: x["value"]), "\n").alias("record"),
    )
    return alone.unionByName(longer.drop("head")).withColumn("record", F.regexp_replace("record", "\r$", ""))
