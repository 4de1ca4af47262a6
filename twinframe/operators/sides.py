"""The tagged union of an original and a synthetic table that all comparisons start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.cells import category_text, decimal_places, is_numeric_type, valid_number

# no column of a table is called so: the tables' own names stand beside it
IS_ORIG = "__original_side__"


def _number(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    if is_numeric_type(data_type):
        return valid_number(name, data_type)
    return F.lit(None).cast("double")  # a non-number never enters a numeric test


def tagged_numbers(orig: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables' numeric columns as doubles (NaN as NULL), with a side flag."""
    sides = [
        df.select(F.lit(flag).alias(IS_ORIG), *[_number(df, c).alias(c) for c in columns])
        for df, flag in ((orig, True), (synth, False))
    ]
    return sides[0].unionAll(sides[1])


def tagged_categories(orig: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """Both tables' categorical columns as text, missing values as the bucket ``null``."""
    sides = [
        df.select(
            F.lit(flag).alias(IS_ORIG),
            *[F.coalesce(category_text(c, df.schema[c].dataType), F.lit("null")).alias(c) for c in columns],
        )
        for df, flag in ((orig, True), (synth, False))
    ]
    return sides[0].unionAll(sides[1])


# a text of more bytes is counted under its digest; a digest is longer itself, so no short text is taken for one
_LONG_TEXT = 48


def compared_counts(orig: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(column, value, category, c1, c2): every different cell of all compared columns, from one scan of each side.

    Numbers come as ``value``, categories as ``category`` (long texts as digests), missing cells as neither,
    and the row without a column counts the rows. Equal cells collapse before the shuffle.
    """
    cells = [F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("category"))]
    cells += [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"), F.lit(None).cast("string").alias("category")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("value"), F.col(f"`{c}`").alias("category")) for c in categorical]

    def category(df: DataFrame, name: str) -> Column:
        text = category_text(name, df.schema[name].dataType)
        return F.when(F.octet_length(text) <= _LONG_TEXT, text).otherwise(F.sha2(text.cast("binary"), 256))

    sides = [
        df.select(F.lit(flag).alias(IS_ORIG), *[_number(df, c).alias(c) for c in numeric], *[category(df, c).alias(c) for c in categorical])
        for df, flag in ((orig, True), (synth, False))
    ]
    long = sides[0].unionAll(sides[1]).select(IS_ORIG, F.inline(F.array(*cells)))
    return long.groupBy("column", "value", "category").agg(
        F.count_if(F.col(IS_ORIG)).alias("c1"), F.count_if(~F.col(IS_ORIG)).alias("c2")
    )


def kind_facts(counts: DataFrame) -> DataFrame:
    """What decides a column's kind, from the counts: distinct values of the original, decimal places, and the largest number."""
    own = (F.col("c1") > 0) & (F.col("value").isNotNull() | F.col("category").isNotNull())
    return counts.where(F.col("column").isNotNull()).groupBy("column").agg(
        F.count_if(own).alias("unique_count"),
        F.max(F.when(own, decimal_places(F.col("value")))).alias("precision"),
        F.max(F.when(own, F.abs("value"))).alias("largest"),
    )


def long_form(tagged: DataFrame, columns: list[str], value: str) -> DataFrame:
    """(is_orig, column, value) rows without missing values.

    Built with ``inline``, not ``unpivot``: plans that use the result twice then share its
    shuffle (the expand node of ``unpivot`` hides that both uses are the same).
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(value)) for c in columns]
    return tagged.select(IS_ORIG, F.inline(F.array(*cells))).where(F.col(value).isNotNull())
