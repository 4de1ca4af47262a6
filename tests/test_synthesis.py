"""Nearest neighbours against brute force, and properties of synthetic tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from twinframe.operators.neighbours import _Candidates, _gathered, _search, feature_arrays, nearest_neighbours
from twinframe.plans.catalogue import CUSTOMER_COLUMNS, customers_with_gaps, table
from twinframe.plans.synthesize import synthesize, table_facts


def brute_force(seeds, originals, categories, k=5):
    """All pairs in plain Python: (i, target) -> [(distance, row), ...]."""
    found = {}
    for s in seeds:
        for t in range(categories):
            ranked = []
            for o in originals:
                square = sum((a - b) * (a - b) for a, b in zip(s.z, o.z))
                other = sum(1 for c in range(categories) if c != t and s.cats[c] != o.cats[c])
                ranked.append(((square + other) ** 0.5, o.row_idx, o.cats[t]))
            found[s.i, t] = sorted(ranked, key=lambda r: r[:2])[:k]
    return found


def neighbour_rows(found):
    out = {}
    for row in found.collect():
        assert list(row.neighbours) == sorted(row.neighbours, key=lambda n: (n.target, n.rank))
        for n in row.neighbours:
            out.setdefault((row.i, n.target), []).append((n.distance, n.row_idx, n["class"]))
    return out


def random_points(spark, rng, rows, numeric, vocabulary, name, hot=0):
    def cats():
        return [rng.choice(words) for words in vocabulary]

    data = [(n, [float(rng.randint(-3, 3)) / 2 for _ in range(numeric)], cats()) for n in range(rows)]
    data = [(n, data[0][1], data[0][2]) if n < hot else (n, z, c) for n, z, c in data]
    rng.shuffle(data)
    return spark.createDataFrame(data, f"{name} bigint, z array<double>, cats array<string>").repartition(4)


FORMS = {
    "broadcast": {"strategy": "broadcast"},
    "blocked": {"strategy": "blocked", "rows_per_block": 16, "queries_per_block": 8},
    "tiny blocks": {"strategy": "blocked", "rows_per_block": 3, "queries_per_block": 2},
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize(
    "numeric, vocabulary, rows, hot",
    [
        (2, [["a", "b", None], ["x", "y"]], 150, 0),
        (1, [["a", "b", "c"]], 150, 60),  # a hot group of copies, one category
        (0, [["a", "b", None], ["x", "y"], ["u", "v"]], 120, 40),  # nothing numeric: all ties
        (3, [["a", None]], 4, 0),  # fewer rows than neighbours
    ],
)
def test_same_neighbours_as_all_pairs(spark, monkeypatch, form, numeric, vocabulary, rows, hot):
    monkeypatch.setattr("twinframe.operators.neighbours._TIGHTEN_FROM", 20)
    rng = random.Random(rows + numeric)
    originals = random_points(spark, rng, rows, numeric, vocabulary, "row_idx", hot)
    seeds = random_points(spark, rng, 40, numeric, vocabulary, "i", hot // 4)
    found = nearest_neighbours(seeds, 40, originals, numeric, len(vocabulary), **FORMS[form])
    expected = brute_force(seeds.collect(), originals.collect(), len(vocabulary))
    assert neighbour_rows(found) == expected


@pytest.mark.parametrize("scanned", [True, False])
@pytest.mark.parametrize("vocabulary", [[["a", "b", None], ["x", "y"], ["u", "v"]], [["a", None]] * 7])
def test_few_queries_go_to_the_originals(spark, monkeypatch, scanned, vocabulary):
    monkeypatch.setattr("twinframe.operators.neighbours.ROWS_PER_SCAN", 30)
    monkeypatch.setattr("twinframe.operators.neighbours.MAX_SCANNED", 12 if scanned else 11)
    rng = random.Random(5)
    originals = random_points(spark, rng, 400, 2, vocabulary, "row_idx", 30)
    seeds = random_points(spark, rng, 12, 2, vocabulary, "i", 3)
    with monkeypatch.context() as small:
        small.setattr("twinframe.operators.neighbours._gathered", lambda batches, rows: _gathered((b.slice(n, 7) for b in batches for n in range(0, len(b), 7)), rows))
        found = nearest_neighbours(seeds, 12, originals, 2, len(vocabulary), strategy="blocked", rows_per_block=16)
        assert ("FlatMapCoGroups" in found._jdf.queryExecution().toString()) != scanned
        assert neighbour_rows(found) == brute_force(seeds.collect(), originals.collect(), len(vocabulary))


@pytest.mark.parametrize("numeric, categories, window_from", [(1, 1, 50), (2, 2, 50), (3, 3, 50), (2, 1, 10**6)])
def test_search_inside_a_task(numeric, categories, window_from):
    rng = np.random.default_rng(numeric)
    size, queries, k = 400, 150, 5
    z = np.round(rng.normal(size=(size, numeric)), 1)
    codes = rng.integers(-1, 3, size=(categories, size)).astype(np.int32)
    z[:120], codes[:, :120] = z[0], codes[:, :1]  # copies
    rows = rng.permutation(size)
    words = [pa.array(["a", "b", "c"])] * categories
    own_z, own_codes = np.round(rng.normal(size=(queries, numeric)), 1), rng.integers(-2, 3, size=(categories, queries))
    radius = np.where(rng.random((queries, categories)) < 0.3, 0.5, np.inf)
    found = _search(_Candidates(rows, z, codes, words), own_z, own_codes, k, radius, window_from)
    got = sorted(zip(*(part.tolist() for part in found)))
    expected = []
    for q in range(queries):
        square = np.zeros(size)
        for p in range(numeric):
            square += (own_z[q, p] - z[:, p]) * (own_z[q, p] - z[:, p])
        for t in range(categories):
            other = sum((own_codes[c, q] != codes[c]).astype(float) for c in range(categories)) - (own_codes[t, q] != codes[t])
            distance = np.sqrt(square + other)
            nearest = [n for n in np.lexsort((rows, distance))[:k] if distance[n] <= radius[q, t]]
            expected += [(q, t, rank + 1, int(n), float(distance[n])) for rank, n in enumerate(nearest)]
    assert got == sorted(expected)


def test_query_with_unseen_category(spark):
    originals = spark.createDataFrame([(n, [0.0], ["a", "x"]) for n in range(9)], "row_idx bigint, z array<double>, cats array<string>")
    seeds = spark.createDataFrame([(0, [0.0], ["new", "x"])], "i bigint, z array<double>, cats array<string>")
    for form in FORMS.values():
        found = neighbour_rows(nearest_neighbours(seeds, 1, originals, 1, 2, **form))
        assert [d for d, *_ in found[0, 1]] == [1.0] * 5 and [r for _, r, _ in found[0, 1]] == [0, 1, 2, 3, 4]
        assert [d for d, *_ in found[0, 0]] == [0.0] * 5


def test_large_text_leaves_the_broadcast_form(spark):
    originals = spark.createDataFrame([(n, [float(n)], ["w" * 100, str(n)]) for n in range(50)], "row_idx bigint, z array<double>, cats array<string>")
    seeds = originals.withColumnRenamed("row_idx", "i")
    small = nearest_neighbours(seeds, 50, originals, 1, 2)
    forced = nearest_neighbours(seeds, 50, originals, 1, 2, broadcast_bytes=5000, rows_per_block=8)
    assert neighbour_rows(small) == neighbour_rows(forced)
    assert "MapInArrow" in small._jdf.queryExecution().toString()
    assert "MapInArrow" not in forced._jdf.queryExecution().toString()


def test_synthetic_rows_stay_in_the_source_domain(spark):
    source = customers_with_gaps(spark, SMALL)
    columns = [*CUSTOMER_COLUMNS, "c_digit"]
    made = synthesize(source, 500, 3, ["c_custkey"], columns)
    assert made.columns == columns and made.count() == 500
    assert [f.dataType for f in made.schema] == [source.schema[c].dataType for c in columns]
    low, high = source.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    assert made.where(~F.col("c_acctbal").between(low, high)).count() == 0
    assert made.where(F.abs(F.round("c_acctbal", 2) - F.col("c_acctbal")) > 1e-9).count() == 0
    known = {r[0] for r in source.select("c_mktsegment").distinct().collect()}
    assert {r[0] for r in made.select("c_mktsegment").distinct().collect()} <= known
    assert made.where("c_acctbal is null").count() == 0


def test_same_seed_same_rows_under_any_partitioning(spark):
    source = customers_with_gaps(spark, SMALL)
    one = synthesize(source, 200, 3, ["c_custkey"], CUSTOMER_COLUMNS, keep_row=True)
    many = synthesize(source.repartition(7), 200, 3, ["c_custkey"], CUSTOMER_COLUMNS, keep_row=True)
    other = synthesize(source, 200, 4, ["c_custkey"], CUSTOMER_COLUMNS, keep_row=True)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    assert sorted(map(repr, one.collect())) != sorted(map(repr, other.collect()))


def test_empty_and_special_tables(spark):
    empty = spark.createDataFrame([], "k bigint, w string")
    assert synthesize(empty, 10, 1, ["k"], ["w"]).count() == 0
    lone = spark.createDataFrame([(n, "ab"[n % 2]) for n in range(30)], "k bigint, w string")
    assert {r.w for r in synthesize(lone, 100, 1, ["k"], ["w"]).collect()} == {"a", "b"}
    wide = table(spark, SMALL, "customer").select("c_custkey", "c_acctbal")
    assert synthesize(wide, 50, 1, ["c_custkey"], ["c_acctbal"]).count() == 50


def test_kinds_and_features(spark):
    source = customers_with_gaps(spark, SMALL).withColumn("flag", F.col("c_custkey") % 2)
    facts = table_facts(source, [*CUSTOMER_COLUMNS, "flag"])
    assert (facts.numeric, facts.categorical) == (["c_nationkey", "c_acctbal"], ["c_mktsegment", "flag"])
    z, cats = feature_arrays(source, facts.numeric, facts.categorical, facts.stats)
    row = source.where("c_acctbal is null").select(z.alias("z"), cats.alias("cats")).first()
    assert row.z[1] == 0.0 and len(row.cats) == 2


def test_names_of_the_library_are_free_for_columns(spark):
    rows = [(n, "ab"[n % 2], n % 17 / 2.0, "xyz"[n % 3], n % 13, f"v{n % 4}") for n in range(120)]
    own = spark.createDataFrame(rows, "i int, z string, key double, cats string, row_idx int, neighbours string")
    names = ["z", "key", "cats", "row_idx", "neighbours"]
    broadcast = synthesize(own, 40, 3, ["i"], names).collect()
    blocked = synthesize(own, 40, 3, ["i"], names, strategy="blocked", rows_per_block=16).collect()
    assert sorted(map(repr, broadcast)) == sorted(map(repr, blocked)) and len(broadcast) == 40
    assert {r.z for r in broadcast} <= {"a", "b"} and {r.cats for r in broadcast} <= {"x", "y", "z"}


def test_wide_tables_stay_within_the_driver_budget(spark, monkeypatch):
    monkeypatch.setattr("twinframe.operators.neighbours.DRIVER_BYTES", 60 * 8 * 8 * 4)
    rng = random.Random(2)
    points = [(n, [rng.random() for _ in range(59)], [rng.choice("ab")]) for n in range(300)]
    originals = spark.createDataFrame(points, "row_idx bigint, z array<double>, cats array<string>")
    seeds = originals.limit(20).withColumnRenamed("row_idx", "i")
    forms = [neighbour_rows(nearest_neighbours(seeds, 20, originals, 59, 1, strategy=s, **o)) for s, o in (("broadcast", {}), ("blocked", {"rows_per_block": 10}))]
    assert forms[0] == forms[1]
