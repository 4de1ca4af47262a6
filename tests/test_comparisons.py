"""Hand-computed comparisons, edge rules and identities."""

import math

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from twinframe.operators.ecdf import complete_ranks, ks_test, mann_whitney, pooled_ecdf, rank_statistics
from twinframe.operators.frequency import category_counts, category_shares, category_tests
from twinframe.operators.histogram import two_sample_histogram
from twinframe.operators.moments import describe, t_test, two_sample_moments
from twinframe.operators.profile import profile
from twinframe.plans.catalogue import LINEITEM_NUMBERS, lineitem_sides, table
from twinframe.plans.report import fidelity_report


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def words(spark, counts):
    return spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "w string")


def number_results(spark, left, right, **options):
    orig, synth = numbers(spark, left), numbers(spark, right)
    moments = two_sample_moments(orig, synth, ["x"])
    ranks = complete_ranks(moments, rank_statistics(pooled_ecdf(orig, synth, ["x"])))
    tests = {"t": t_test(moments), "mw": mann_whitney(ranks, **options), "ks": ks_test(ranks)}
    return {name: df.first() for name, df in tests.items()}, describe(moments).first()


def word_results(spark, left, right):
    counts = category_counts(words(spark, left), words(spark, right), ["w"])
    return category_tests(category_shares(counts)).first()


def test_small_numeric_samples(spark):
    found, interval = number_results(spark, [1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 4.0])
    assert found["ks"].statistic == pytest.approx(5 / 12)
    assert found["ks"].p_value == 1.0
    assert found["mw"].statistic == pytest.approx(2.5)
    assert found["mw"].p_value == pytest.approx(0.2159249, abs=1e-6)
    assert found["t"].statistic == pytest.approx(2.4494897, abs=1e-6)
    assert found["t"].p_value == pytest.approx(0.0917, abs=1e-4)
    assert interval.diff == pytest.approx(1.0)


def test_tie_correction_widens_z(spark):
    plain, _ = number_results(spark, [1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 4.0])
    corrected, _ = number_results(spark, [1.0, 2.0, 2.0, 3.0], [2.0, 3.0, 4.0], tie_correction=True)
    assert corrected["mw"].p_value < plain["mw"].p_value


@pytest.mark.parametrize("right", [[], [None, float("nan")]])
def test_empty_synthetic_side(spark, right):
    found, interval = number_results(spark, [1.0, 2.0, 3.0], right)
    assert [(r.statistic, r.p_value, r.is_similar) for r in found.values()] == [(0.0, 1.0, True)] * 3
    assert interval is None


def test_one_original_value(spark):
    found, interval = number_results(spark, [5.0], [4.0, 6.0])
    assert (found["t"].statistic, found["t"].p_value) == (0.0, 1.0)
    assert interval is None


def test_constant_sides(spark):
    found, interval = number_results(spark, [5.0, 5.0], [6.0, 6.0])
    assert found["t"].statistic == math.inf and found["t"].p_value == 1.0
    assert (interval.diff, interval.ci_lower, interval.ci_upper) == (1.0, 1.0, 1.0)


def test_chi_square_with_missing_bucket(spark):
    found = word_results(spark, {"a": 5, "b": 3, None: 2}, {"a": 8, "b": 9, None: 3})
    assert found.chi_square == pytest.approx(2.15)
    assert found.chi_p == pytest.approx(0.3412978, abs=1e-6)
    assert found.cramers_v == pytest.approx(0.2318405, abs=1e-6)
    assert found.tvd == pytest.approx(0.15)


def test_synthetic_only_category_counts_for_tvd_alone(spark):
    found = word_results(spark, {"a": 5, "b": 5}, {"a": 4, "b": 4, "c": 2})
    assert (found.chi_square, found.cramers_v, found.tvd) == tuple(pytest.approx(x) for x in (0.4, 0.2, 0.2))


def test_one_category_has_no_chi_square(spark):
    orig, synth = words(spark, {"a": 3}), words(spark, {"a": 5})
    report = fidelity_report(orig, synth)
    row = report.stats_summary().first()
    assert (row.chi_square_p, row.cramers_v, row.tvd, row.is_similar) == (None, None, 0.0, "YES")
    assert report.categorical_table().first().chi_p_shown == "N/A"
    assert report.stats_summary_text().first()["Cramers V"] == "N/A"
    assert "1. Descriptive Statistics" not in [r.line for r in report.text().collect()]


def test_empty_synthetic_categories(spark):
    found = word_results(spark, {"a": 1, "b": 1}, {})
    assert (found.chi_square, found.chi_p, found.cramers_v, found.tvd) == (0.0, 1.0, 0.0, 0.5)


def test_table_equals_itself(spark):
    lines = table(spark, SMALL, "lineitem")
    report = fidelity_report(lines, lines, [*LINEITEM_NUMBERS, "l_returnflag", "l_tax"])
    for row in report.tests().collect():
        assert row.is_similar
        if row.test != "mw":
            assert row.statistic == pytest.approx(0.0, abs=1e-9)


def test_swapped_sides(spark):
    orig, synth = lineitem_sides(spark, SMALL)
    there = {r.column: r for r in rank_statistics(pooled_ecdf(orig, synth, LINEITEM_NUMBERS)).collect()}
    back = {r.column: r for r in rank_statistics(pooled_ecdf(synth, orig, LINEITEM_NUMBERS)).collect()}
    for column, row in there.items():
        assert row.d == pytest.approx(back[column].d)
        u1 = row.rank_sum - row.n1 * (row.n1 + 1) / 2
        u2 = back[column].rank_sum - row.n2 * (row.n2 + 1) / 2
        assert u1 + u2 == pytest.approx(row.n1 * row.n2)


@pytest.mark.parametrize("rows_per_range", [100, 1500])
def test_ranges_do_not_change_the_ecdf(spark, rows_per_range):
    sides = lineitem_sides(spark, SMALL)
    whole = pooled_ecdf(*sides, LINEITEM_NUMBERS)
    cut = pooled_ecdf(*sides, LINEITEM_NUMBERS, rows_per_range=rows_per_range)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_hot_value_in_cut_ecdf(spark):
    hot = numbers(spark, [7.0] * 3000 + [float(v) for v in range(200)])
    other = numbers(spark, [float(v) for v in range(100)])
    whole, cut = (pooled_ecdf(hot, other, ["x"], rows_per_range=n) for n in (10**6, 50))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_histogram_edges_and_missing(spark):
    orig = numbers(spark, [0.0, 15.0, None, 1.0])
    synth = numbers(spark, [15.0, 14.0])
    rows = {r.bin: r for r in two_sample_histogram(orig, synth, ["x"]).collect()}
    assert len(rows) == 15
    assert (rows[0].orig_share, rows[1].orig_share, rows[14].orig_share) == (0.25, 0.25, 0.25)
    assert rows[14].aug_share == 1.0 and rows[14].peak_share_aug == 1.0


def test_histogram_of_one_value_and_of_none(spark):
    one = two_sample_histogram(numbers(spark, [2.0]), numbers(spark, [2.0]), ["x"]).where("orig_share > 0").collect()
    assert [(r.bin, r.orig_share) for r in one] == [(0, 1.0)]
    assert two_sample_histogram(numbers(spark, [None]), numbers(spark, [None]), ["x"]).count() == 0


def test_missing_columns_are_reported(spark):
    orig = spark.createDataFrame([(n / 2, "ab"[n % 2], n) for n in range(40)], "x double, is_orig string, column int")
    report = fidelity_report(orig, orig.select("column"), exact_counts=False)
    rows = {r.variable: r for r in report.stats_summary().collect()}
    assert set(rows) == {"x", "is_orig", "column"}
    assert rows["is_orig"].tvd == 1.0 and rows["x"].ks_p == 1.0 and rows["column"].tvd is None


def test_report_from_one_count_table(spark):
    """Kinds, missing cells, the text 'null', long texts and large whole numbers, without a second scan."""
    rows = [(float(n), n % 4, 2**60 + n, ["null", None, "x" * 900 + str(n % 3), "short"][n % 4]) for n in range(60)]
    orig = spark.createDataFrame(rows, "x double, few int, large long, word string")
    synth = spark.createDataFrame([(n + 1.0, None if n % 2 else 1, 2**60 + n, "short") for n in range(30)], orig.schema)
    report = fidelity_report(orig, synth)
    found = {r.column: (r.type, r.unique_count, r.precision) for r in report.profile.collect()}
    assert found == {r.column: (r.type, r.unique_count, r.precision) for r in profile(orig).collect()}
    assert found["large"][:2] == ("numerical", 60) and found["few"][0] == "categorical"
    moments = {r.column: r for r in two_sample_moments(orig, synth, ["x", "large"]).collect()}
    for r in report.numbers.collect():
        for name in ("mean_o", "std_o", "min_o", "max_o", "count_o", "mean_a", "std_a", "min_a", "max_a", "count_a"):
            # values near 2^60 are 128 apart as doubles, and so are the rounded means
            assert r[name] == pytest.approx(moments[r.column][name], rel=1e-9, abs=1e-9 if r.column == "x" else 64)
    expected = {r.column: r for r in category_tests(category_shares(category_counts(orig, synth, ["few", "word"]))).collect()}
    for r in report.categories.collect():
        assert r.tvd == pytest.approx(expected[r.column].tvd) and r.chi_square == pytest.approx(expected[r.column].chi_square)
    # no text over the length of a digest is shuffled or kept
    assert report.counts.agg(F.max(F.length("category"))).first()[0] == 64
    bars = report.histograms().where("column = 'x'").collect()
    assert {(b.bin, round(b.orig_share, 9), round(b.aug_share, 9)) for b in bars} == {
        (b.bin, round(b.orig_share, 9), round(b.aug_share, 9)) for b in two_sample_histogram(orig, synth, ["x"]).collect()
    }
