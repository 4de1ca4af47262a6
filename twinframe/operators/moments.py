"""Means, deviations and what follows from them: Welch interval and one-sample t."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from twinframe.functions.cells import valid_number
from twinframe.functions.distributions import student_t_critical, student_t_p
from twinframe.operators.sides import IS_ORIG, tagged_numbers

# Fixed value: results with a p above it count as similar.
ALPHA = 0.05


@dataclass(frozen=True)
class NumberStats:
    column: str
    mean: float
    std: float
    min: float
    max: float
    is_integer: bool


def stat_fields(df: DataFrame, name: str) -> list[Column]:
    value = valid_number(name, df.schema[name].dataType)
    return [
        F.lit(name).alias("column"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"),
        F.coalesce(F.min(value), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("max"),
        F.coalesce(F.bool_and(value == F.floor(value)), F.lit(False)).alias("is_integer"),
    ]


def synthesis_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, range and integrality per column; zeros when empty."""
    facts = F.array(*[F.struct(*stat_fields(df, name)) for name in columns])
    return df.agg(facts.alias("facts")).select(F.inline("facts"))


def steady_stats(row: Row) -> NumberStats:
    """Statistics for use in later expressions, at 12 significant digits.

    The order in which partial sums meet moves the last digits of a mean. Rounding them off makes it
    rare that two runs differ in distances, and so in neighbour ties; two sums on both sides of a
    rounding edge still can.
    """
    mean, std = (float(f"{row[x]:.12g}") for x in ("mean", "std"))
    return NumberStats(row["column"], mean, std, row["min"], row["max"], row["is_integer"])


def two_sample_moments(orig: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, range and count per column and side, in one aggregation."""
    facts = []
    for name in columns:
        measures = [F.lit(name).alias("column")]
        for side, flag in (("o", F.col(IS_ORIG)), ("a", ~F.col(IS_ORIG))):
            value = F.when(flag, F.col(f"`{name}`"))
            measures += [
                F.avg(value).alias(f"mean_{side}"),
                F.stddev_samp(value).alias(f"std_{side}"),
                F.min(value).alias(f"min_{side}"),
                F.max(value).alias(f"max_{side}"),
                F.count(value).alias(f"count_{side}"),
            ]
        facts.append(F.struct(*measures))
    both = tagged_numbers(orig, synth, columns)
    return both.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def moments_of_counts(counts: DataFrame) -> DataFrame:
    """The same without deviations, from distinct values and their counts (column, value, c1, c2)."""
    measures = []
    for side, c in (("o", "c1"), ("a", "c2")):
        held = F.when(F.col(c) > 0, F.col("value"))
        measures += [
            F.try_divide(F.sum(F.col("value") * F.col(c)), F.sum(c)).alias(f"mean_{side}"),
            F.min(held).alias(f"min_{side}"),
            F.max(held).alias(f"max_{side}"),
            F.sum(c).alias(f"count_{side}"),
        ]
    return counts.groupBy("column").agg(*measures)


def deviation(side: str, c: str) -> Column:
    """Sample deviation around a side's known mean, as an aggregate over distinct values and their counts."""
    gap = F.col("value") - F.col(f"mean_{side}")
    spare = F.max(f"count_{side}") - 1
    return F.when(spare > 0, F.sqrt(F.sum(gap * gap * F.col(c)) / F.when(spare > 0, spare))).alias(f"std_{side}")


def named_result(tested: DataFrame, prefix: str) -> DataFrame:
    """One test's result: column, statistic, p_value, is_similar."""
    names = {"statistic": "statistic", "p": "p_value", "similar": "is_similar"}
    return tested.select("column", *[F.col(f"{prefix}_{x}").alias(name) for x, name in names.items()])


def with_interval(moments: DataFrame) -> DataFrame:
    """Both sides' statistics with ``diff`` of the means and its Welch 95% interval.

    These are NULL where a side has fewer than two values.
    """
    enough = (F.col("count_o") >= 2) & (F.col("count_a") >= 2)
    share_o, share_a = (F.try_divide(F.pow(F.col(f"std_{s}"), 2), F.col(f"count_{s}")) for s in ("o", "a"))
    spread = share_o + share_a
    weight = F.try_divide(F.pow(share_o, 2), F.col("count_o") - 1) + F.try_divide(F.pow(share_a, 2), F.col("count_a") - 1)
    df = F.when(enough & (weight > 0), F.try_divide(F.pow(spread, 2), weight))
    critical = F.coalesce(student_t_critical(F.lit(1 - ALPHA / 2), df), F.lit(1.96))
    margin = F.when(weight > 0, F.nanvl(critical, F.lit(1.96))).otherwise(1.96) * F.sqrt(spread)
    found = moments.withColumns({"diff": F.when(enough, F.col("mean_a") - F.col("mean_o")), "margin": margin})
    return found.withColumns({"ci_lower": F.col("diff") - F.col("margin"), "ci_upper": F.col("diff") + F.col("margin")}).drop("margin")


def describe(moments: DataFrame) -> DataFrame:
    """Statistics and interval of the columns that have at least two values on both sides."""
    return with_interval(moments).where((F.col("count_o") >= 2) & (F.col("count_a") >= 2))


def with_t_test(moments: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Moments with ``t_statistic``, ``t_p`` and ``t_similar``: is the synthetic mean plausible under the original sample?

    One-sample, two-sided. Too little data gives statistic 0 and p 1; an undefined p counts as 1.
    """
    enough = (F.col("count_o") >= 2) & (F.col("count_a") >= 1)
    gap = F.col("mean_a") - F.col("mean_o")
    error = F.when(enough, F.try_divide(F.col("std_o"), F.sqrt(F.col("count_o"))))
    t = F.when(error > 0, F.try_divide(gap, error)).when(gap == 0, F.lit(float("nan"))).when(
        error == 0, F.signum(gap) * float("inf")
    )
    defined = F.when(error > 0, t)
    tested = moments.withColumns(
        {"t_statistic": F.when(enough, t).otherwise(0.0), "t_p": student_t_p(defined, (F.col("count_o") - 1).cast("double"))}
    )
    p = F.coalesce(F.nanvl("t_p", F.lit(1.0)), F.lit(1.0))
    return tested.withColumn("t_p", p).withColumn("t_similar", F.col("t_p") > alpha)


def t_test(moments: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The one-sample t test of the synthetic mean."""
    return named_result(with_t_test(moments, alpha), "t")
