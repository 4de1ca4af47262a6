"""Two-sample histograms over a common range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.operators.sides import IS_ORIG, long_form, tagged_numbers

# Number of bins, what closes the last one, and the least height scaled to.
BINS = 15
_LAST_EDGE = 0.0001
_LOWEST_PEAK = 0.001


def two_sample_histogram(orig: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Equal-width bins over the pooled range, heights as shares of all rows of a side.

    Missing values stay out of the bins but in the denominator. Columns without any number
    give no rows. ``peak_share_*`` is the height relative to the tallest bar of the column.
    """
    tagged = tagged_numbers(orig, synth, columns)
    ranges = [
        F.struct(F.lit(c).alias("column"), F.min(f"`{c}`").alias("low"), F.max(f"`{c}`").alias("high"))
        for c in columns
    ]
    found = tagged.agg(
        F.array(*ranges).alias("ranges"),
        F.count_if(F.col(IS_ORIG)).alias("n_orig"),
        F.count_if(~F.col(IS_ORIG)).alias("n_aug"),
    ).select(F.inline("ranges"), "n_orig", "n_aug")
    one = F.col(IS_ORIG).cast("int")
    cells = long_form(tagged, columns, "value").select("column", "value", one.alias("c1"), (1 - one).alias("c2"))
    return _bars(cells, found)


def histogram_of_counts(counts: DataFrame, rows: tuple[int, int], columns: list[str]) -> DataFrame:
    """The same from distinct values and their counts (column, value, c1, c2), and the number of rows of each side."""
    cells = counts.where(F.col("column").isin(columns) & F.col("value").isNotNull())
    found = cells.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return _bars(cells, found.select("*", F.lit(rows[0]).alias("n_orig"), F.lit(rows[1]).alias("n_aug")))


def _bars(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Bars from (column, value, c1, c2) and (column, low, high, n_orig, n_aug)."""
    # Collected, one row per column: it is used twice below, and is one scan this way
    spans = cells.sparkSession.createDataFrame(found.where(F.col("low").isNotNull()).toArrow()).withColumn(
        "step", F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("high") - F.col("low")) / BINS)
    )
    # the bin is the number of inner edges not above the value: the same comparisons as bin by bin
    inner = [(F.col("value") >= F.col("low") + i * F.col("step")).cast("int") for i in range(1, BINS)]
    binned = (
        cells.join(F.broadcast(spans.select("column", "low", "step")), "column")
        .withColumn("bin", reduce(lambda a, b: a + b, inner))
        .groupBy("column", "bin")
        .agg(F.sum("c1").alias("c_orig"), F.sum("c2").alias("c_aug"))
    )
    bins = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    low_edge = F.col("low") + F.col("bin") * F.col("step")
    high_edge = F.when(F.col("bin") == BINS - 1, F.col("high") + _LAST_EDGE).otherwise(
        F.col("low") + (F.col("bin") + 1) * F.col("step")
    )
    shares = bins.join(binned, ["column", "bin"], "left").select(
        "column",
        "bin",
        low_edge.alias("bin_min"),
        high_edge.alias("bin_max"),
        (F.coalesce("c_orig", F.lit(0)) / F.greatest("n_orig", F.lit(1))).alias("orig_share"),
        (F.coalesce("c_aug", F.lit(0)) / F.greatest("n_aug", F.lit(1))).alias("aug_share"),
        F.format_string("%.1f", "low").alias("low_label"),
        F.format_string("%.1f", "high").alias("high_label"),
    )
    peak = F.greatest(
        F.max(F.greatest("orig_share", "aug_share")).over(Window.partitionBy("column")), F.lit(_LOWEST_PEAK)
    )
    return shares.withColumn("peak_share_orig", F.col("orig_share") / peak).withColumn(
        "peak_share_aug", F.col("aug_share") / peak
    )
