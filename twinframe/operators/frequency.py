"""Category counts of two tables, and chi-square, Cramer's V and total variation on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.functions.distributions import chi_square_p
from twinframe.operators.moments import ALPHA
from twinframe.operators.sides import IS_ORIG, long_form, tagged_categories

# Fixed value: a total variation distance below it counts as similar.
TVD_LIMIT = 0.1


def category_counts(orig: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column and category on each side, missing values in the bucket ``null``."""
    tagged = long_form(tagged_categories(orig, synth, columns), columns, "category")
    return tagged.groupBy("column", "category").agg(
        F.count_if(F.col(IS_ORIG)).alias("c_orig"), F.count_if(~F.col(IS_ORIG)).alias("c_aug")
    )


def category_shares(counts: DataFrame) -> DataFrame:
    """Category counts with side totals and shares; a side without rows has share 0.

    The totals are one row per column, built from the same shuffled counts.
    """
    totals = counts.groupBy("column").agg(F.sum("c_orig").alias("n_orig"), F.sum("c_aug").alias("n_aug"))
    return (
        counts.join(F.broadcast(totals), "column")
        .withColumn("p_orig", F.col("c_orig") / F.greatest("n_orig", F.lit(1)))
        .withColumn("p_aug", F.col("c_aug") / F.greatest("n_aug", F.lit(1)))
    )


def category_tests(shares: DataFrame, alpha: float = ALPHA, tvd_limit: float = TVD_LIMIT) -> DataFrame:
    """Per column: total variation distance, and chi-square with Cramer's V.

    Chi-square compares synthetic counts with the original shares, over original categories
    only; columns with fewer than two of those have no chi-square result (NULL).
    """
    known = F.col("c_orig") > 0
    expected = F.col("p_orig") * F.col("n_aug")
    term = F.when(known & (expected > 0), F.try_divide(F.pow(F.col("c_aug") - expected, 2), expected))
    summed = shares.groupBy("column").agg(
        (F.sum(F.abs(F.col("p_orig") - F.col("p_aug"))) / 2).alias("tvd"),
        F.coalesce(F.sum(term), F.lit(0.0)).alias("chi_square"),
        F.count_if(known).alias("categories"),
        F.max("n_aug").alias("n_aug"),
    )
    tested = F.col("categories") >= 2
    df = F.col("categories") - 1
    v = F.coalesce(F.sqrt(F.try_divide(F.col("chi_square"), F.col("n_aug") * df)), F.lit(0.0))
    p = chi_square_p(F.when(tested, F.col("chi_square")), df.cast("double"))
    return (
        summed.withColumn("p", F.coalesce(F.nanvl(p, F.lit(1.0)), F.lit(1.0)))
        .select(
            "column",
            "tvd",
            (F.col("tvd") < tvd_limit).alias("tvd_similar"),
            F.when(tested, F.col("chi_square")).alias("chi_square"),
            F.when(tested, F.col("p")).alias("chi_p"),
            F.when(tested, v).alias("cramers_v"),
            F.when(tested, F.col("p") > alpha).alias("chi_similar"),
        )
    )


def chi_square_test(tests: DataFrame) -> DataFrame:
    return tests.where(F.col("chi_p").isNotNull()).select(
        "column",
        F.col("chi_square").alias("statistic"),
        F.col("chi_p").alias("p_value"),
        "cramers_v",
        F.col("chi_similar").alias("is_similar"),
    )


def total_variation(tests: DataFrame) -> DataFrame:
    return tests.select("column", F.col("tvd").alias("value"), F.col("tvd_similar").alias("is_similar"))
