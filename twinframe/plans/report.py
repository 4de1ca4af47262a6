"""The fidelity report: every comparison of two tables, and the views built on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.cells import is_numeric_type
from twinframe.operators.ecdf import rank_statistics, running_counts, with_ks_test, with_mann_whitney
from twinframe.operators.frequency import category_shares, category_tests
from twinframe.operators.histogram import histogram_of_counts
from twinframe.operators.moments import deviation, moments_of_counts, with_interval, with_t_test
from twinframe.operators.profile import badge, collect_profile, profile, profile_of_counts, split_by_kind
from twinframe.operators.sides import compared_counts
from twinframe.sources.csv import ROW_INDEX
from twinframe.sources.scratch import cut_lineage

# The unchanging lines of the text report.
TEXT_TITLE = ["Statistical Comparison Report", "=============================", ""]
TEXT_SECTION = ["1. Descriptive Statistics", "-------------------------"]
TEXT_FOOTER = ["", "... (detailed p-values, TVD, and Cramers V available in CSV Summary)"]

_NUMBER_SCHEMA = (
    "column string, mean_o double, std_o double, min_o double, max_o double, count_o bigint, "
    "mean_a double, std_a double, min_a double, max_a double, count_a bigint, "
    "diff double, ci_lower double, ci_upper double, t_statistic double, t_p double, t_similar boolean, "
    "mw_statistic double, mw_p double, mw_similar boolean, ks_statistic double, ks_p double, ks_similar boolean"
)
_CATEGORY_SCHEMA = (
    "column string, tvd double, tvd_similar boolean, chi_square double, chi_p double, cramers_v double, "
    "chi_similar boolean"
)


def fixed(value: Column, places: Column | int) -> Column:
    """A number with a fixed number of decimals, which may differ per row."""
    digits = F.lit(places) if isinstance(places, int) else places
    text = F.call_function("format_string", F.concat(F.lit("%."), digits.cast("string"), F.lit("f")), value)
    return F.when(value.isNotNull(), text)  # format_string spells NULL out


def shown_p(p: Column) -> Column:
    return F.when(p < 0.001, "< 0.001").when(p.isNotNull(), fixed(p, 3))


def effect_band(v: Column) -> Column:
    """How large an association a Cramer's V stands for."""
    return F.when(v < 0.1, "negligible").when(v < 0.3, "moderate").otherwise("large")


def tvd_band(tvd: Column) -> Column:
    return F.when(tvd < 0.1, "good").otherwise("warning")


def fidelity_label(similar: Column) -> Column:
    return F.when(similar, "HIGH").otherwise("LOW")


def _held(rows: DataFrame) -> DataFrame:
    """A table of one row per column, fetched: what starts from it costs no further job over the data."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def number_tests(counts: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numerical column: both sides' statistics, interval and three tests.

    ``counts`` are written counts of distinct values (column, value, c1, c2): means are weighted sums of
    them, deviations are taken around the means in the pass that also makes the ranks.
    """
    spark = counts.sparkSession
    if not columns:
        return spark.createDataFrame([], _NUMBER_SCHEMA)
    every = spark.createDataFrame([(c,) for c in columns], "column string")
    centres = _held(every.join(moments_of_counts(counts), "column", "left").fillna(0, ["count_o", "count_a"]))
    ranked = running_counts(counts).join(F.broadcast(centres), "column")
    found = _held(rank_statistics(ranked, [deviation("o", "c1"), deviation("a", "c2")]))
    # every column's figures in one row, so no test joins another
    rows = centres.join(found, "column", "left").fillna(0, ["n1", "n2"])
    tested = with_ks_test(with_mann_whitney(with_t_test(with_interval(rows))))
    return tested.select(*[field.split()[0] for field in _NUMBER_SCHEMA.split(", ")])


def categorical_tests(counts: DataFrame, columns: list[str]) -> DataFrame:
    """One row per categorical column: TVD, chi-square and Cramer's V, from counts (column, category, c1, c2)."""
    if not columns:
        return counts.sparkSession.createDataFrame([], _CATEGORY_SCHEMA)
    return category_tests(category_shares(counts.select("column", "category", F.col("c1").alias("c_orig"), F.col("c2").alias("c_aug"))))


@dataclass
class FidelityReport:
    """Test results, one row per column, with the report's views as methods.

    ``numbers`` and ``categories`` are made once with the report, from ``counts``: the different cells of
    all columns with how often each occurs on either side. The views don't read the tables again.
    """

    counts: DataFrame
    profile: DataFrame
    numbers: DataFrame
    categories: DataFrame

    def column_types(self) -> DataFrame:
        return self.profile.select("column", "type")

    def descriptive(self) -> DataFrame:
        """Means and interval of columns that have at least two values on both sides."""
        return self.numbers.where(F.col("diff").isNotNull()).drop(
            *[f"{t}_{x}" for t in ("t", "mw", "ks") for x in ("statistic", "p", "similar")]
        )

    def tests(self) -> DataFrame:
        """All results in long form: column, test, statistic, p_value, effect, is_similar."""

        def rows(source: DataFrame, test: str, statistic: str, p: str | None, effect: str | None, similar: str):
            return source.where(F.col(similar).isNotNull()).select(
                "column",
                F.lit(test).alias("test"),
                F.col(statistic).alias("statistic"),
                (F.col(p) if p else F.lit(None).cast("double")).alias("p_value"),
                (F.col(effect) if effect else F.lit(None).cast("double")).alias("effect"),
                F.col(similar).alias("is_similar"),
            )

        parts = [rows(self.numbers, t, f"{t}_statistic", f"{t}_p", None, f"{t}_similar") for t in ("t", "mw", "ks")]
        parts.append(rows(self.categories, "chi", "chi_square", "chi_p", "cramers_v", "chi_similar"))
        parts.append(rows(self.categories, "tvd", "tvd", None, None, "tvd_similar"))
        joined = parts[0]
        for part in parts[1:]:
            joined = joined.unionAll(part)
        return joined.join(self.profile.select("column", "unique_count"), "column")

    def test_table(self) -> DataFrame:
        """The numeric tests as shown: badge, distinct count, p, statistic, HIGH / LOW."""
        return (
            self.tests()
            .drop("unique_count")
            .where(F.col("test").isin("t", "mw", "ks"))
            .join(badge(self.profile), "column")
            .select(
                "column",
                "test",
                "badge",
                "unique_count",
                shown_p(F.col("p_value")).alias("p_shown"),
                fixed(F.col("statistic"), 2).alias("statistic_shown"),
                fidelity_label(F.col("is_similar")).alias("fidelity"),
            )
        )

    def categorical_table(self) -> DataFrame:
        """Categorical results as shown; without a chi-square result V counts as 0."""
        v = F.coalesce("cramers_v", F.lit(0.0))
        similar = F.coalesce("chi_similar", F.lit(False)) | (v < 0.1) | F.col("tvd_similar")
        return self.categories.join(badge(self.profile), "column").select(
            "column",
            "badge",
            "unique_count",
            F.coalesce(shown_p(F.col("chi_p")), F.lit("N/A")).alias("chi_p_shown"),
            v.alias("cramers_v"),
            effect_band(v).alias("effect_band"),
            "tvd",
            fidelity_label(similar).alias("fidelity"),
        )

    def descriptive_table(self) -> DataFrame:
        """Means and interval at the precision of the column."""
        p = F.col("precision")
        return (
            self.descriptive()
            .join(self.profile, "column")
            .select(
                "ordinal",
                "column",
                fixed(F.col("mean_o"), p).alias("mean_orig"),
                fixed(F.col("mean_a"), p).alias("mean_aug"),
                fixed(F.col("ci_lower"), p).alias("ci_lower"),
                fixed(F.col("ci_upper"), p).alias("ci_upper"),
            )
        )

    def stats_summary(self) -> DataFrame:
        """One row per column with every result; NULL where a result does not apply."""
        numeric = F.col("type") == "numerical"
        number_ok = F.col("t_similar") & F.col("mw_similar") & F.col("ks_similar")
        category_ok = (
            F.coalesce("chi_similar", F.lit(False))
            | F.coalesce(F.col("cramers_v") < 0.1, F.lit(False))
            | F.col("tvd_similar")
        )
        return (
            self.profile.join(self.numbers, "column", "left")
            .join(self.categories, "column", "left")
            .select(
                F.col("column").alias("variable"),
                "ordinal",
                "type",
                F.col("unique_count").alias("unique_values"),
                F.when(F.col("is_heuristic_categorical"), "Categorical").otherwise("Standard").alias("heuristic"),
                "precision",
                F.col("t_p").alias("t_test_p"),
                F.col("mw_p").alias("mann_whitney_p"),
                "ks_p",
                F.col("diff").alias("mean_difference"),
                "ci_lower",
                "ci_upper",
                F.col("chi_p").alias("chi_square_p"),
                "cramers_v",
                "tvd",
                F.when(F.when(numeric, number_ok).otherwise(category_ok), "YES").otherwise("NO").alias("is_similar"),
            )
        )

    def stats_summary_text(self) -> DataFrame:
        """The summary as written to CSV: fixed decimals, N/A where a result is missing."""
        numeric = F.col("type") == "numerical"

        def cell(name: str, places: Column | int, applies: Column) -> Column:
            return F.when(applies, F.coalesce(fixed(F.col(name), places), F.lit("N/A")))

        return self.stats_summary().select(
            "ordinal",
            F.col("variable").alias("Variable"),
            F.col("type").alias("Type"),
            F.col("unique_values").alias("UniqueValues"),
            F.col("heuristic").alias("Heuristic"),
            cell("t_test_p", 5, numeric).alias("T-Test P"),
            cell("mann_whitney_p", 5, numeric).alias("Mann-Whitney P"),
            cell("ks_p", 5, numeric).alias("KS-Test P"),
            cell("mean_difference", F.col("precision"), numeric).alias("Mean Difference"),
            cell("ci_lower", F.col("precision"), numeric).alias("CI Lower"),
            cell("ci_upper", F.col("precision"), numeric).alias("CI Upper"),
            cell("chi_square_p", 5, ~numeric).alias("Chi-Square P"),
            cell("cramers_v", 4, ~numeric).alias("Cramers V"),
            cell("tvd", 5, ~numeric).alias("TVD"),
            F.col("is_similar").alias("Is Similar"),
        )

    def summary(self) -> DataFrame:
        """One row: similar counts, averages, totals, similarity rates and bands."""
        both = self.numbers.withColumn("_numeric", F.lit(True)).unionByName(
            self.categories.withColumn("_numeric", F.lit(False)), allowMissingColumns=True
        )
        counted = both.agg(
            *[F.count_if(F.col(f"{t}_similar")).alias(f"{t}_similar") for t in ("t", "mw", "ks", "chi")],
            F.coalesce(F.avg("tvd"), F.lit(0.0)).alias("avg_tvd"),
            F.coalesce(F.avg("cramers_v"), F.lit(0.0)).alias("avg_cramers_v"),
            F.count_if("_numeric").alias("total_numerical"),
            F.count_if(~F.col("_numeric")).alias("total_categorical"),
        )

        def rate(similar: str, total: str) -> Column:
            return F.coalesce(F.try_divide(F.col(similar), F.col(total)) * 100, F.lit(0.0))

        return counted.select(
            "*",
            rate("t_similar", "total_numerical").alias("t_rate"),
            rate("ks_similar", "total_numerical").alias("ks_rate"),
            rate("chi_similar", "total_categorical").alias("chi_rate"),
            tvd_band(F.col("avg_tvd")).alias("tvd_band"),
            effect_band(F.col("avg_cramers_v")).alias("effect_band"),
        )

    def histograms(self) -> DataFrame:
        """Two-sample histograms of the columns in the descriptive list."""
        columns = [row["column"] for row in self.descriptive().select("column").collect()]
        rows = self.counts.where(F.col("column").isNull()).agg(F.sum("c1"), F.sum("c2")).first()
        return histogram_of_counts(self.counts, (rows[0] or 0, rows[1] or 0), columns)

    def text(self) -> DataFrame:
        """The text report as (line_no, line); the section is left out when it would be empty."""
        title, section, footer = TEXT_TITLE, TEXT_SECTION, TEXT_FOOTER
        shown = self.descriptive_table()

        def lines(texts: list[Column]) -> Column:
            return F.posexplode(F.array(*texts)).alias("at", "line")

        fixed_lines = [F.lit(x) for x in title]
        frame = shown.agg(F.count(F.lit(1)).alias("n"))
        head = frame.select(lines(fixed_lines)).select(F.col("at").cast("bigint").alias("line_no"), "line")
        start = frame.where(F.col("n") > 0).select(lines([F.lit(x) for x in section]))
        start = start.select((F.col("at") + len(title)).cast("bigint").alias("line_no"), "line")
        entry = [
            F.lit(""),
            F.concat("column", F.lit(":")),
            F.concat(F.lit("  Mean: "), "mean_orig", F.lit(" -> "), "mean_aug"),
            F.concat(F.lit("  95% CI Diff: ["), "ci_lower", F.lit(", "), "ci_upper", F.lit("]")),
        ]
        body = shown.select("ordinal", lines(entry)).select(
            (F.col("ordinal") * len(entry) + F.col("at") + len(title) + len(section)).cast("bigint").alias("line_no"),
            "line",
        )
        end = frame.select(lines([F.lit(x) for x in footer])).select(
            (F.lit(2**40) + F.col("at")).cast("bigint").alias("line_no"), "line"
        )
        return head.unionAll(start).unionAll(body).unionAll(end)


def fidelity_report(
    orig: DataFrame,
    synth: DataFrame,
    columns: list[str] | None = None,
    profiled: DataFrame | None = None,
    exact_counts: bool = True,
) -> FidelityReport:
    """Compare two tables column by column; kinds and precision come from the original only.

    Every column of the original is reported; one that the synthetic table lacks counts as missing
    in all its rows. ``profiled`` is the profile of the original when there is one already, as after an import.
    ``exact_counts=False`` estimates distinct counts, as ``profile`` does, for tables where an exact count costs too much.
    Each table is read once, for the counts that everything else derives from (with estimates the original once more).
    """
    counts = None
    if profiled is None:
        columns = columns or [c for c in orig.columns if c != ROW_INDEX or c in synth.columns]
        chosen = orig.select(*[f"`{c}`" for c in columns])
        if exact_counts:
            numbers, texts = partition(columns, lambda c: is_numeric_type(orig.schema[c].dataType))
            counts = cut_lineage(compared_counts(orig, _completed(synth, orig, columns), numbers, texts))
            profiled = _held(profile_of_counts(chosen, counts))
        else:
            profiled = _held(profile(chosen, exact=False))
    kinds = collect_profile(profiled)
    numeric, categorical = split_by_kind(kinds)
    if counts is None:
        counts = cut_lineage(compared_counts(orig, _completed(synth, orig, [c.column for c in kinds]), numeric, categorical))
    numbers = counts.where(F.col("column").isin(numeric) & F.col("value").isNotNull()).select("column", "value", "c1", "c2")
    # missing cells are a category of their own, together with the text that it is called by
    category = F.coalesce("category", F.col("value").cast("string"), F.lit("null")).alias("category")
    categories = counts.where(F.col("column").isin(categorical)).groupBy("column", category).agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    return FidelityReport(counts, profiled, _held(number_tests(numbers, numeric)), _held(categorical_tests(categories, categorical)))


def _completed(synth: DataFrame, orig: DataFrame, columns: list[str]) -> DataFrame:
    """The synthetic table with the columns that it lacks, without values."""
    lacking = {c: F.lit(None).cast(orig.schema[c].dataType) for c in columns if c not in synth.columns}
    return synth.withColumns(lacking) if lacking else synth


def partition(names: list[str], test: Callable[[str], bool]) -> tuple[list[str], list[str]]:
    return [n for n in names if test(n)], [n for n in names if not test(n)]
