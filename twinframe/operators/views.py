"""Nearest neighbours among rows that agree with a query in a set of categories (a view).

A row that differs from a query in exactly ``level`` of a target's other categories is at the root
of ``level`` plus the squared z-score differences. It can be one of the k nearest only if it is
one of the k nearest by z-scores in the view of the categories that it shares with the query, so
a search in every view, from the most categories to none, finds all. Views at a level that the
k-th distance so far has not reached need no search.
"""

from __future__ import annotations

import numpy as np

PAIRS_PER_STEP = 1_000_000
_QUERIES_PER_STEP = 16_384


def _groups(theirs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per row and query, equal where all codes are."""
    rows = theirs.shape[1]
    group = np.zeros(rows + own.shape[1], dtype=np.int64)
    for column in np.concatenate([theirs, own], axis=1).astype(np.int64) + 2:  # NULL is -1, an unknown word -2
        _, group = np.unique(group * (column.max(initial=0) + 1) + column, return_inverse=True)
    return group[:rows], group[rows:]


def _first_at(line: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """The first place in [low, high) of a sorted stretch whose entry is at least (after: above) the value."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high) // 2
        entry = line[np.minimum(middle, len(line) - 1)]
        up = (low < high) & ((entry <= value) if after else (entry < value))
        low, high = np.where(up, middle + 1, low), np.where(up | (low >= high), high, middle)
    return low


def search_view(
    rows: np.ndarray,
    their_z: np.ndarray,
    their_codes: np.ndarray,
    z: np.ndarray,
    codes: np.ndarray,
    radius: np.ndarray,
    view: int,
    k: int,
) -> tuple[np.ndarray, ...]:
    """(query, target, candidate, distance): at least those of the k nearest that this view holds.

    ``view`` has a bit for each category that must agree; all others but the target must differ.
    ``radius`` gives a distance per query and target beyond which nothing is wanted, negative for none.
    """
    categories, queries = codes.shape
    shared = [c for c in range(categories) if view >> c & 1]
    level = categories - 1 - len(shared)
    nothing = tuple(np.empty(0, dtype=t) for t in (int, int, int, float))
    if not len(rows) or not queries:
        return nothing
    group, asked = _groups(their_codes[shared], codes[shared])
    if their_z.shape[1]:
        column = max(range(their_z.shape[1]), key=lambda p: len(np.unique(their_z[:, p])))
        line, at = their_z[:, column], z[:, column]
    else:
        line, at = np.zeros(len(rows)), np.zeros(queries)
    order = np.lexsort((rows, *their_z.T, line, group))
    # of rows alike in group and z-scores none but the first k can be near
    alike = (group[order][1:] == group[order][:-1]) & (their_z[order][1:] == their_z[order][:-1]).all(axis=1)
    starts = np.nonzero(np.concatenate([[True], ~alike]))[0]
    copy = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[copy < k]
    group, line, their_z = group[order], line[order], their_z[order]
    their_rows, their_codes = rows[order], their_codes[:, order]
    first, end = np.searchsorted(group, asked), np.searchsorted(group, asked, "right")
    wanted = np.where(radius >= 0, radius * radius, -np.inf)
    wanted = wanted[:, [t for t in range(categories) if t not in shared]].max(axis=1) - level

    def squares(query: np.ndarray, place: np.ndarray) -> np.ndarray:
        square = np.zeros(len(query))
        for p in range(z.shape[1]):
            gap = z[query, p] - their_z[place, p]
            square += gap * gap
        return square

    found = []
    for low in range(0, queries, _QUERIES_PER_STEP):
        own = np.arange(low, min(queries, low + _QUERIES_PER_STEP))
        own = own[(end[own] > first[own]) & (wanted[own] >= -1e-9 * (1.0 + level))]
        if not len(own):
            continue
        # the k-th of some rows close by bounds the k-th of all
        middle = _first_at(line, at[own], first[own], end[own], False)
        start = np.maximum(first[own], np.minimum(middle - 4 * k, end[own] - 8 * k))
        place = start[:, None] + np.arange(8 * k)
        near = squares(np.repeat(own, 8 * k), np.minimum(place, len(line) - 1).ravel()).reshape(place.shape)
        near[place >= end[own][:, None]] = np.inf
        limit = np.maximum(np.minimum(np.partition(near, k - 1, axis=1)[:, k - 1], wanted[own]), 0.0)
        limit = limit * (1.0 + 1e-9) + 1e-9 * (1.0 + level)  # rounding must not lose a tie
        reach = np.sqrt(limit) * (1.0 + 1e-9)
        start = _first_at(line, at[own] - reach, first[own], end[own], False)
        width = _first_at(line, at[own] + reach, first[own], end[own], True) - start
        done = 0
        total = np.cumsum(width)
        while done < len(own):
            before = total[done] - width[done]
            upto = max(done + 1, int(np.searchsorted(total, before + PAIRS_PER_STEP, "right")))
            some = np.arange(done, upto)
            which = np.repeat(some, width[some])
            place = np.arange(len(which)) - np.repeat(total[some] - width[some] - before, width[some]) + start[which]
            square = squares(own[which], place)
            kept = square <= limit[which]
            query, place, square = own[which[kept]], place[kept], square[kept]
            differs = codes[:, query] != their_codes[:, place]
            count = differs.sum(axis=0)
            for target in range(categories):
                if target in shared:
                    continue
                distance = np.sqrt(square + float(level))
                exact = np.nonzero((count - differs[target] == level) & (distance <= radius[query, target]))[0]
                exact = exact[np.lexsort((their_rows[place[exact]], distance[exact], query[exact]))]
                by_query = query[exact]
                exact = exact[np.arange(len(exact)) - np.searchsorted(by_query, by_query) < k]
                found.append((query[exact], np.full(len(exact), target), order[place[exact]], distance[exact]))
            done = upto
    return tuple(np.concatenate(part) for part in zip(*found)) if found else nothing
