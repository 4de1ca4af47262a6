"""Cells, profiles, draws and distribution functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from twinframe.functions import distributions as D
from twinframe.functions.cells import canonical_text, clean_text, decimal_places, parse_number, round_half_up, round_to_places
from twinframe.functions.rng import standard_normal, uniform, vote_choice, weighted_choice
from twinframe.operators.moments import NumberStats
from twinframe.operators.profile import apply_types, collect_profile, numeric_text, profile, profile_text
from twinframe.operators.ranges import KEY_LENGTH, _cut_key, with_row_index
from twinframe.plans.synthesize import jittered


def column(spark, values, kind, expression):
    df = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}").repartition(3)
    return [r.y for r in df.select("n", expression(F.col("x")).alias("y")).orderBy("n").collect()]


def test_missing_tokens(spark):
    cells = ["null", " NaN ", "N/A", "Continuous", "undefined", "none", "", " ", "0", " null﻿"]
    assert column(spark, cells, "string", clean_text) == [None] * 5 + ["none", None, " ", "0", None]


def test_numbers_in_text(spark):
    cells = ["1", " -2.5 ", ".5", "3.", "1e3", "1d", "Infinity", "+1", "1,5", "9007199254740993", "x"]
    assert column(spark, cells, "string", parse_number) == [1.0, -2.5, 0.5, 3.0, 1000.0] + [None] * 6


def test_canonical_categories(spark):
    cells = ["1", "1.0", "1e0", "TRUE", "true", "abc", "0.50"]
    assert column(spark, cells, "string", canonical_text) == ["1", "1", "1", "true", "true", "abc", "0.5"]


def test_decimal_places(spark):
    values = [0.07, 1.50, 5.0, 1e25, 12345678.25, 1.5e-7, None]
    assert column(spark, values, "double", decimal_places) == [2, 1, 0, 0, 2, 8, 0]


def test_decimal_places_agree_with_the_text(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(-1e4, 1e4), rng.randint(0, 9)) for _ in range(3000)]
    texts = [repr(v) for v in values]
    assert not any("e" in t for t in texts)
    expected = [0 if t.endswith(".0") else len(t.split(".")[1]) for t in texts]
    assert column(spark, values, "double", decimal_places) == expected


def test_rounding_goes_up_at_halves(spark):
    assert column(spark, [-2.5, 2.5, -0.5, 1e300], "double", round_half_up) == [-2.0, 3.0, 0.0, 1e300]
    assert column(spark, [1.25, -1.25], "double", lambda x: round_to_places(x, 1)) == [1.3, -1.2]


def text_profile(spark, cells):
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cells)], "row_idx bigint, x string").repartition(4)
    return df, collect_profile(profile_text(df, "row_idx"))


@pytest.mark.parametrize("numbers_first, kind", [(50, "numerical"), (49, "categorical")])
def test_probe_reads_fifty_values(spark, numbers_first, kind):
    cells = ["null", ""] + [str(n) for n in range(numbers_first)] + ["word"] * 5 + ["7.25"]
    df, profiles = text_profile(spark, cells)
    assert (profiles[0].type, profiles[0].unique_count) == (kind, numbers_first + 2)
    typed = apply_types(df, profiles).where("x is not null").count()
    assert typed == (numbers_first + 1 if kind == "numerical" else numbers_first + 6)


@pytest.mark.parametrize("distinct, kind", [(10, "categorical"), (11, "numerical")])
def test_cardinality_limit(spark, distinct, kind):
    _, profiles = text_profile(spark, [str(n % distinct) for n in range(100)])
    assert (profiles[0].type, profiles[0].is_heuristic_categorical) == (kind, distinct == 10)
    typed = spark.createDataFrame([(float(n % distinct),) for n in range(100)], "x double")
    assert collect_profile(profile(typed))[0].type == kind
    assert collect_profile(profile(typed, exact=False))[0].type == kind


def test_probe_goes_on_until_a_column_has_its_values(spark, monkeypatch):
    monkeypatch.setattr("twinframe.operators.profile.PROBE_ROWS", 64)
    rows = [(1000 + 3 * n, str(n), str(n) if n % 40 == 0 else None, str(n) if n < 30 else "w", "w" if n == 2999 else "1") for n in range(3000)]
    df = spark.createDataFrame(rows + [(None, "word", "word", "1", "word")], "at bigint, a string, rare string, early string, late string").repartition(3)
    kinds = {p.column: (p.type, p.unique_count) for p in collect_profile(profile_text(df, "at"))}
    assert kinds == {"a": ("numerical", 3001), "rare": ("numerical", 76), "early": ("categorical", 31), "late": ("categorical", 3)}
    assert numeric_text(df.where("at IS NULL").withColumnRenamed("at", "_at"), ["a"]) == {"a": True}
    words = df.where("at IS NOT NULL").select(F.format_string("k%06d", "at").alias("at"), "a", "early")
    assert [p.type for p in collect_profile(profile_text(words, "at"))] == ["numerical", "categorical"]


def test_all_missing_column_is_categorical(spark):
    _, profiles = text_profile(spark, ["null", "", "NaN"])
    assert (profiles[0].type, profiles[0].unique_count) == ("categorical", 0)
    empty = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert collect_profile(profile(empty))[0].type == "categorical"


def test_uniforms_look_uniform_and_do_not_depend_on_partitions(spark):
    def draws(parts):
        rows = spark.range(0, 20000, 1, parts)
        return sorted(rows.select("id", uniform(1, F.col("id"), "a").alias("u"), standard_normal(1, F.col("id"), "b").alias("z")).collect())

    one, many = draws(1), draws(7)
    assert one == many
    u, z = [r.u for r in one], [r.z for r in one]
    assert 0 < min(u) and max(u) < 1 and sum(u) / len(u) == pytest.approx(0.5, abs=0.01)
    assert sum(z) / len(z) == pytest.approx(0.0, abs=0.03)
    assert math.sqrt(sum(v * v for v in z) / len(z)) == pytest.approx(1.0, abs=0.03)


def pick(spark, expression):
    return spark.range(1).select(expression.alias("p")).first().p


def test_vote_choice_walks_classes_in_first_seen_order(spark):
    votes = F.array(*[F.lit(v).cast("string") for v in ("b", "a", "b", None, "a")])
    found = [pick(spark, vote_choice(votes, F.lit(u))) for u in (0.01, 0.4, 0.41, 0.8, 0.81, 0.999)]
    assert found == ["b", "b", "a", "a", None, None]
    assert pick(spark, vote_choice(F.array().cast("array<string>"), F.lit(0.5))) is None


def test_weighted_choice(spark):
    def options(*pairs):
        return F.array(*[F.struct(F.lit(v).alias("value"), F.lit(w).alias("weight")) for v, w in pairs])

    three = options(("x", 1), ("y", 3), ("z", 1))
    assert [pick(spark, weighted_choice(three, F.lit(u))) for u in (0.2, 0.21, 0.8, 0.81)] == ["x", "y", "y", "z"]
    assert pick(spark, weighted_choice(options(("x", 0), ("y", 0)), F.lit(0.5))) == "x"
    empty = F.filter(three, lambda o: o["weight"] > 9)
    assert pick(spark, weighted_choice(empty, F.lit(0.5))) is None


def test_known_tail_probabilities():
    assert D.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert D.student_t_two_sided(2.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2.0), abs=1e-12)
    assert D.student_t_two_sided(1.0, 2) == pytest.approx(1 - 1 / math.sqrt(3), abs=1e-12)
    assert D.student_t_quantile(0.975, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-9)
    assert D.student_t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert D.chi_square_tail(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert D.chi_square_tail(1.0, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-12)
    assert D.chi_square_tail(60.0, 4) == pytest.approx(math.exp(-30) * 31, rel=1e-10)


def test_large_degrees_of_freedom_are_continuous():
    for below, above in ((1e5, 1e5 + 1),):
        assert D.student_t_two_sided(2.3, below) == pytest.approx(D.student_t_two_sided(2.3, above), rel=1e-6)
    assert D.chi_square_tail(2e7 + 5000, 2e7) == pytest.approx(D.chi_square_tail(2e7 + 5001, 2e7 + 1), rel=1e-3)


@pytest.mark.parametrize("rows_per_range", [10**6, 40])
def test_row_index_is_dense_and_ordered(spark, rows_per_range):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(5)
    rows = with_row_index(df.withColumn("extra", F.lit(1)), ["g", "k"], rows_per_range).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(1000))
    assert [(r.g, r.k) for r in rows] == sorted((r.g, r.k) for r in rows)


def test_row_index_of_hot_copies(spark, monkeypatch):
    monkeypatch.setattr("twinframe.operators.ranges._COPIES_PER_PIECE", 64)
    df = spark.createDataFrame([("a",)] * 700 + [("b",)] * 3 + [("c",)] * 200, "w string").repartition(4)
    rows = with_row_index(df, ["w"], 100).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(903))
    assert [r.w for r in rows] == ["a"] * 700 + ["b"] * 3 + ["c"] * 200


@pytest.mark.parametrize(
    "kind", ["timestamp", "timestamp_ntz", "date", "decimal(20,3)", "string", "double", "int", "boolean"]
)
def test_row_index_by_keys_of_any_type(spark, kind):
    number = F.col("id") * 86400
    made = {
        "timestamp": F.timestamp_seconds(number),
        "timestamp_ntz": F.timestamp_seconds(number).cast("timestamp_ntz"),
        "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")),
        "string": F.concat(F.lit("k\"'\\é"), F.lpad(F.col("id").cast("string"), 4, "0")),
        "boolean": F.col("id") >= 150,
    }
    key = made.get(kind, F.col("id").cast(kind) / 4 if kind == "double" else F.col("id").cast(kind))
    df = spark.range(300).select(key.alias("k"), F.col("id")).repartition(4)
    rows = with_row_index(df, ["k", "id"], 20).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(300))
    assert [r.id for r in rows] == list(range(300))


@pytest.mark.parametrize(
    "kind, values",
    [
        ("double", [None, 1.5, float("nan"), -2.0, None, float("nan"), 7.0]),
        ("binary", [b"b", None, b"", b"a\xff", b"a"]),
        ("string", ["x" * 100_000, None, "", "y" * 50_000 + "a", "y" * 50_000 + "b"]),
    ],
)
def test_row_index_takes_any_key(spark, kind, values):
    rows = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    numbered = with_row_index(rows, ["k"], 2).orderBy("row_idx").collect()
    assert [r.row_idx for r in numbered] == list(range(len(values)))
    rank = lambda v: (v is not None, v != v, v if v is not None and v == v else 0)
    assert [rank(r.k) for r in numbered] == sorted(rank(v) for v in values)


def test_a_key_with_copies_is_rejected(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        with_row_index(rows, ["k"])
    long = spark.range(40).select(F.concat(F.repeat(F.lit("x"), 3000), (F.col("id") % 39).cast("string")).alias("k"), "id")
    with pytest.raises(ValueError, match="not unique"):
        with_row_index(long, ["k"], 5)


def test_long_keys_are_cut_by_their_beginnings(spark):
    million = F.repeat(F.lit("é"), 500_000)
    key = F.concat(F.lpad((F.col("id") * 7 % 60).cast("string"), 2, "0"), F.when(F.col("id") % 3 > 0, million).otherwise(""))
    df = spark.range(120).select(key.alias("k"), (F.col("id") % 2).alias("g"), F.col("id").alias("v")).repartition(6)
    numbered = with_row_index(df, ["k", "g", "v"], 10).select("row_idx", "k", "g", "v").orderBy("row_idx").collect()
    assert [r.row_idx for r in numbered] == list(range(120))
    assert [(r.k, r.g, r.v) for r in numbered] == sorted((r.k, r.g, r.v) for r in numbered)
    cut = df.select(*[c.alias(f"c{at}") for at, c in enumerate(_cut_key(df, ["k", "g", "v"]))])
    widest = cut.select(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    assert widest < 4 * KEY_LENGTH  # what the driver samples of a key of a megabyte


def test_numbers_may_stand_between_any_white_space(spark):
    rows = spark.createDataFrame([("12\u00a0",), ("\u20031.5 ",), ("1 2",)], "v string")
    assert [r[0] for r in rows.select(parse_number(F.col("v"))).collect()] == [12.0, 1.5, None]


def test_jitter_without_spread_or_number(spark):
    row = spark.range(1).select(F.col("id").alias("i"), F.lit(3.25).alias("x"), F.lit(float("nan")).alias("gap"))
    flat = NumberStats("x", 3.25, 0.0, 3.25, 3.25, False)
    wide = NumberStats("gap", 1.0, 2.0, 0.0, 5.0, False)
    out = row.select(jittered(F.col("x"), "x", flat, 2, 1), jittered(F.col("gap"), "gap", wide, 2, 1)).first()
    assert out[0] == 3.25 and out[1] != out[1]


def test_fractions_that_do_not_converge_raise():
    with pytest.raises(ArithmeticError):
        D._beta_fraction(float("inf"), 0.5, 0.9)


def test_one_text_per_instant(spark):
    cells = {
        "2024-03-10T12:00:00Z": "2024-03-10T12:00:00.000Z",
        "2024-03-10T14:00:00+02:00": "2024-03-10T12:00:00.000Z",
        "2024-03-10T12:00Z": "2024-03-10T12:00:00.000Z",
        "2024-03-10T12:00:00.0009Z": "2024-03-10T12:00:00.000Z",
        "2024-03-10T12:00:00.120-00:30": "2024-03-10T12:30:00.120Z",
        "1969-12-31T23:59:59.999Z": "1969-12-31T23:59:59.999Z",
        "0001-01-01T00:00:00Z": "0001-01-01T00:00:00.000Z",
        "2024-03-10T12:00:00": "2024-03-10T12:00:00",
        "2024-03-10": "2024-03-10",
        "2024-02-31T12:00:00Z": "2024-02-31T12:00:00Z",
        "2024-03-10T12:00:00+25:00": "2024-03-10T12:00:00+25:00",
        " 2024-03-10T12:00:00Z": " 2024-03-10T12:00:00Z",
    }
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {r.cell: r.text for r in df.select("cell", canonical_text(F.col("cell")).alias("text")).collect()} == cells
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("copies", [False, True])
def test_row_index_of_float_keys_in_many_ranges(spark, copies, request):
    # small partitions must not be merged into one, as large ones aren't
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    values = [None, float("nan"), 0.0, *[n / 7 for n in range(-400, 400)]]
    rows = [(v, n % 3) for n, v in enumerate(values)] * (2 if copies else 1)
    made = with_row_index(spark.createDataFrame(rows, "v double, k long").repartition(5), ["v", "k"], 50)
    unique = with_row_index(spark.createDataFrame([(*r, "x") for r in rows[: len(values)]], "v double, k long, other string"), ["v", "k"], 50)
    for found, times in ((made, 2 if copies else 1), (unique, 1)):
        ordered = [(r.v, r.k) for r in sorted(found.collect(), key=lambda r: r.row_idx)]
        expected = sorted(rows[: len(values)], key=lambda r: (r[0] is not None, r[0] != r[0], r[0] if r[0] == r[0] else 0, r[1]))
        assert list(map(repr, ordered)) == [repr(r) for r in expected for _ in range(times)]
        assert sorted(r.row_idx for r in found.collect()) == list(range(len(expected) * times))
    with pytest.raises(ValueError, match="not unique"):
        with_row_index(spark.createDataFrame([(1.5, n) for n in range(2)], "v double, n long"), ["v"], 50)
