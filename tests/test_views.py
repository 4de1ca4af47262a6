"""The search by views against all pairs, on rows with ties, copies, missing and unknown categories."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from twinframe.operators import neighbours
from twinframe.operators.neighbours import _Candidates, _search, nearest_neighbours
from twinframe.operators.views import search_view


@pytest.mark.parametrize("categories", [1, 2, 3])
@pytest.mark.parametrize("numeric", [0, 1, 2])
@pytest.mark.parametrize("rows", [3, 40, 900])
def test_views_together_hold_the_nearest(rows, numeric, categories):
    rng = np.random.default_rng(rows + 10 * numeric + categories)
    k, queries = 5, 60
    z = np.round(rng.normal(size=(rows, numeric)), 1)
    codes = rng.integers(-1, 4, size=(categories, rows)).astype(np.int32)
    own_z = np.round(rng.normal(size=(queries, numeric)), 2)
    own_codes = rng.integers(-2, 4, size=(categories, queries)).astype(np.int32)
    candidates = _Candidates(rng.permutation(rows), z, codes, [pa.array(list("abcd"))] * categories)
    # all pairs, with no group of rows sorted or left out
    query, target, rank, place, near = _search(candidates, own_z, own_codes, k, window_from=10**9)
    wanted = sorted(zip(query, target, near, candidates.rows[place]))
    found = []
    for size in range(categories):
        for shared in combinations(range(categories), size):
            view = sum(1 << c for c in shared)
            radius = np.full((queries, categories), np.inf)
            radius[:, list(shared)] = -1.0
            q, t, at, distance = search_view(candidates.rows, z, codes, own_z, own_codes, radius, view, k)
            found += zip(q, t, distance, candidates.rows[at])
    assert len(found) == len(set(found))
    best: dict = {}
    for entry in sorted(found):
        kept = best.setdefault(entry[:2], [])
        if len(kept) < k:
            kept.append(entry)
    assert sorted(e for kept in best.values() for e in kept) == wanted


def test_a_wide_radius_is_its_own_querys_alone(spark, monkeypatch):
    """A query that finds nothing close by looks everywhere; the others in its batch don't."""
    visited = []

    def counted(visits, *rest):
        visited.append(visits.groupBy("i").count().collect())
        return search_blocks(visits, *rest)

    search_blocks = neighbours._search_blocks
    monkeypatch.setattr(neighbours, "_search_blocks", counted)
    rows = [(n, [n / 75], ["a", "x"]) for n in range(1500)]
    # one query far off, whose k-th neighbour in its block is further away than most blocks
    asked = [(n, [n / 10 + 0.001], ["a", "x"]) for n in range(200)] + [(200, [90.0], ["a", "x"])]
    originals = spark.createDataFrame(rows, "row_idx bigint, z array<double>, cats array<string>")
    seeds = spark.createDataFrame(asked, "i bigint, z array<double>, cats array<string>").coalesce(1)
    forms = ({"strategy": "broadcast"}, {"strategy": "blocked", "rows_per_block": 32})
    first, second = (nearest_neighbours(seeds, 201, originals, 1, 2, **form).orderBy("i").select("i", "neighbours").collect() for form in forms)
    assert first == second
    routed = {r["i"]: r["count"] for r in visited[1]}  # the second search goes beyond the own block
    assert max(n for i, n in routed.items() if i < 200) <= 4
    assert len(routed) < 100  # most have all neighbours in their own block
