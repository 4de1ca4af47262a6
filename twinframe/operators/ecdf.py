"""Pooled cumulative counts, and the Kolmogorov-Smirnov and Mann-Whitney tests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.functions.distributions import normal_two_sided_p
from twinframe.operators.moments import ALPHA, named_result
from twinframe.operators.ranges import ROWS_PER_RANGE
from twinframe.operators.sides import IS_ORIG, long_form, tagged_numbers
from twinframe.sources.scratch import cut_lineage


def value_counts(orig: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column with their counts on both sides (c1, c2), from one scan; written.

    Equal values collapse before the shuffle, so a value holding a third of all rows is one row.
    """
    pooled = long_form(tagged_numbers(orig, synth, columns), columns, "value")
    return cut_lineage(
        pooled.groupBy("column", "value").agg(
            F.count_if(F.col(IS_ORIG)).alias("c1"), F.count_if(~F.col(IS_ORIG)).alias("c2")
        )
    )


def pooled_ecdf(
    orig: DataFrame, synth: DataFrame, columns: list[str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Distinct values per column with counts (c1, c2), running counts (k1, k2) and sizes (n1, n2)."""
    return running_counts(value_counts(orig, synth, columns), rows_per_range)


def running_counts(counts: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Written counts per column and value, with running counts (k1, k2) and sizes (n1, n2).

    Running counts are taken inside ranges of distinct values, which the engine cuts, and shifted by
    the totals of the ranges before; the largest window group is one range, not one column.
    """
    ranges = -(-counts.count() // rows_per_range)
    if ranges > 1:
        dealt = counts.repartitionByRange(ranges, "column", "value").withColumn("_range", F.spark_partition_id())
        placed = cut_lineage(dealt)
    else:
        placed = counts.withColumn("_range", F.lit(0))

    column = Window.partitionBy("column")
    earlier = column.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("column", "_range").agg(F.sum("c1").alias("t1"), F.sum("c2").alias("t2"))
    offsets = totals.select(
        "column",
        "_range",
        F.coalesce(F.sum("t1").over(earlier), F.lit(0)).alias("before1"),
        F.coalesce(F.sum("t2").over(earlier), F.lit(0)).alias("before2"),
        F.sum("t1").over(column).alias("n1"),
        F.sum("t2").over(column).alias("n2"),
    )
    running = (
        Window.partitionBy("column", "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # offsets hold at most one row per column and range
    return placed.join(offsets, ["column", "_range"]).select(
        "column",
        "value",
        "c1",
        "c2",
        (F.col("before1") + F.sum("c1").over(running)).alias("k1"),
        (F.col("before2") + F.sum("c2").over(running)).alias("k2"),
        "n1",
        "n2",
    )


def average_rank() -> Column:
    """The rank of a pooled value, ties sharing their mean rank."""
    own = F.col("c1") + F.col("c2")
    return F.col("k1") + F.col("k2") - own + (own + 1) / F.lit(2.0)


def rank_statistics(ecdf: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """Per column: largest gap between the two ECDFs, rank sum of the original side, and ``more`` aggregates."""
    gap = F.abs(F.try_divide("k1", "n1") - F.try_divide("k2", "n2"))
    ties = F.pow((F.col("c1") + F.col("c2")).cast("double"), 3) - (F.col("c1") + F.col("c2"))
    return ecdf.groupBy("column").agg(
        F.max(gap).alias("d"),
        F.sum(F.col("c1") * average_rank()).alias("rank_sum"),
        F.sum(ties).alias("ties"),
        F.max("n1").alias("n1"),
        F.max("n2").alias("n2"),
        *(more or []),
    )


def _both_sides() -> Column:
    return (F.col("n1") > 0) & (F.col("n2") > 0)


def with_ks_test(ranks: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Rank statistics with ``ks_statistic``, ``ks_p`` and ``ks_similar``; p is the first term of the series, capped at 1."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    size = F.try_divide(n1 * n2, n1 + n2)
    p = F.least(F.lit(1.0), 2.0 * F.exp(-2.0 * size * F.col("d") * F.col("d")))
    tested = {"ks_statistic": F.when(_both_sides(), F.col("d")).otherwise(0.0), "ks_p": F.when(_both_sides(), p).otherwise(1.0)}
    return ranks.withColumns(tested).withColumn("ks_similar", F.col("ks_p") > alpha)


def ks_test(ranks: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov."""
    return named_result(with_ks_test(ranks, alpha), "ks")


def with_mann_whitney(ranks: DataFrame, alpha: float = ALPHA, tie_correction: bool = False) -> DataFrame:
    """Rank statistics with ``mw_statistic`` (U of the original side), ``mw_p`` (normal approximation) and ``mw_similar``."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    total = n1 + n2
    spread = total + 1
    if tie_correction:
        spread = spread - F.try_divide(F.col("ties"), total * (total - 1))
    sigma = F.sqrt(n1 * n2 * spread / 12)
    z = F.when(_both_sides() & (sigma > 0), F.try_divide(u - n1 * n2 / 2, sigma))
    p = F.coalesce(F.nanvl("mw_p", F.lit(1.0)), F.lit(1.0))
    tested = ranks.withColumns({"mw_statistic": F.when(_both_sides(), u).otherwise(0.0), "mw_p": normal_two_sided_p(z)})
    return tested.withColumn("mw_p", p).withColumn("mw_similar", F.col("mw_p") > alpha)


def mann_whitney(ranks: DataFrame, alpha: float = ALPHA, tie_correction: bool = False) -> DataFrame:
    """Mann-Whitney U of the original side."""
    return named_result(with_mann_whitney(ranks, alpha, tie_correction), "mw")


def complete_ranks(moments: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rank statistics for every column of the moments, also those without any number."""
    filled = moments.select("column").join(ranks, "column", "left")
    return filled.fillna(0, ["n1", "n2"])


