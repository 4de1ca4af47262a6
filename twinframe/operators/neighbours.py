"""Exact k nearest neighbours under a mixed numeric / categorical distance.

Distance of a synthetic row to an original row, for a target category: the root of the squared
z-score differences plus 1 for every *other* categorical column where the original row differs
from the synthetic row's seed row. Ties go to the lower row index. Neighbours for all targets
come from one pass: a target's distance is the full mismatch count less its own mismatch.

Two physical forms give the same rows:

* ``broadcast``: the original features fit a byte limit, checked by summing them up, and the pairs
  of rows a limit too; synthetic rows stay where they are.
* ``blocked``: beyond the limits. Up to ``MAX_SCANNED`` queries go to the originals: these are read
  once, in blocks as they lie, and each task keeps the nearest of its blocks so far. For more
  queries originals are cut into blocks of similar rows; every synthetic row searches the block it falls in, and then only those whose bounding box is no further away
  than its k-th neighbour so far. With up to ``MAX_VIEWED`` categories and many queries that is done once for
  every view (see ``views``) in reach, by blocks of equal categories; otherwise once over all categories,
  (with many blocks) with the nearest others in between. Where a block is hot, equal feature rows
  collapse to their first k copies (no later copy can be among k neighbours), and what is
  still large is split, like the queries, so that a task sees a bounded piece of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinframe.functions.cells import category_text, valid_number
from twinframe.operators.moments import NumberStats
from twinframe.operators.views import search_view
from twinframe.sources.csv import ROW_INDEX
from twinframe.sources.scratch import cut_lineage

# Fixed value: how many neighbours vote.
K_NEIGHBOURS = 5
BROADCAST_BYTES = 16 * 1024 * 1024
# beyond as many pairs of rows, comparing all would take longer than the passes of the blocked form
BROADCAST_PAIRS = 500_000_000
# up to as many categories have a view for each of their sets
MAX_VIEWED = 6
QUERIES_FOR_VIEWS = 8  # for one query in as many originals, at least
# up to as many queries, of as many bytes, are broadcast to the originals where views don't pay
MAX_SCANNED = 4096
SCANNED_BYTES = 16 * 1024 * 1024
ROWS_PER_SCAN = 65_536
PAIRS_PER_TASK = 50_000_000
CELLS_PER_STEP = 2_000_000

ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 8192
MAX_BLOCKS = 1 << 18
_SAMPLE_PER_BLOCK = 12
# what the driver may hold of the sample and of the tree's boxes, whatever the number of columns
DRIVER_BYTES = 256 * 1024 * 1024
_NEARBY_BLOCKS = 2
_TIGHTEN_FROM = 512

NEIGHBOUR_TYPE = "struct<target:int,rank:int,row_idx:bigint,distance:double,class:string>"
_PARTIAL_SCHEMA = "i bigint, target int, distance double, row_idx bigint, class string"
_VISIT_SCHEMA = "i bigint, z array<double>, cats array<string>, radius array<double>, leaf bigint"
_VIEW_SCHEMA = "i bigint, z array<double>, cats array<string>, radius array<double>, view int, leaf bigint"
_BLOCK_KEYS = ["leaf", "part", "chunk"]


def zscore(value: Column, stats: NumberStats) -> Column:
    """(x - mean) / deviation; 0 for missing values and constant columns."""
    if not stats.std > 0:
        return F.lit(0.0)
    return F.coalesce((value - F.lit(stats.mean)) / F.lit(stats.std), F.lit(0.0))


def feature_arrays(
    df: DataFrame, numeric: list[str], categorical: list[str], stats: dict[str, NumberStats]
) -> tuple[Column, Column]:
    """Column expressions for the z-scores and for the categories as text."""
    kinds = {f.name: f.dataType for f in df.schema}
    z = [zscore(valid_number(c, kinds[c]), stats[c]) for c in numeric]
    cats = [category_text(c, kinds[c]) for c in categorical]
    return F.array(*z).cast("array<double>"), F.array(*cats).cast("array<string>")


@dataclass
class _Candidates:
    """Original rows, with categories as codes into per-column word lists."""

    rows: np.ndarray
    z: np.ndarray
    codes: np.ndarray
    words: list[pa.Array]

    @staticmethod
    def of(table: pa.Table, categories: int) -> _Candidates:
        table = table.combine_chunks()
        columns = [
            pc.dictionary_encode(pc.list_element(table["cats"], c)).combine_chunks() for c in range(categories)
        ]
        codes = [pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False) for c in columns]
        return _Candidates(
            table[ROW_INDEX].to_numpy(),
            _matrix(table["z"], len(table)),
            np.array(codes, dtype=np.int32).reshape(categories, len(table)),
            [c.dictionary for c in columns],
        )

    def encode(self, cats: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """Codes of query categories: -1 for NULL, -2 for words no candidate has."""
        codes = []
        for c, words in enumerate(self.words):
            cell = pc.list_element(cats, c)
            known = pc.fill_null(pc.index_in(cell, value_set=words, skip_nulls=True), -2)
            codes.append(pc.if_else(pc.is_null(cell), -1, known).to_numpy(zero_copy_only=False))
        return np.array(codes, dtype=np.int32).reshape(len(self.words), len(cats))

    def texts(self, targets: np.ndarray, places: np.ndarray) -> pa.Array:
        """The class text of candidate ``places[n]`` in column ``targets[n]``."""
        out = np.empty(len(places), dtype=object)
        for c, words in enumerate(self.words):
            at = np.nonzero(targets == c)[0]
            codes = self.codes[c, places[at]]
            out[at] = words.take(pa.array(codes, mask=codes < 0)).to_numpy(zero_copy_only=False)
        return pa.array(out, type=pa.string())


def _matrix(lists: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False) if rows else np.empty(0)
    return flat.astype(np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def _search(
    candidates: _Candidates,
    z: np.ndarray,
    codes: np.ndarray,
    k: int,
    radius: np.ndarray | None = None,
    window_from: int = 4096,
) -> tuple[np.ndarray, ...]:
    """(query, target, rank, candidate, distance) of the k nearest, ties by row order.

    ``radius`` gives a distance per query and target beyond which no neighbour is wanted. Many
    candidates are sorted by the numeric column that tells most of them apart, and queries close
    to each other in it are compared with the stretch that can hold their neighbours only.
    """
    size, queries = len(candidates.rows), codes.shape[1]
    if radius is None:
        radius = np.full((queries, len(candidates.words)), np.inf)
    if size < window_from or not z.shape[1]:
        return _search_all(candidates, np.arange(size), z, codes, k, radius, np.arange(queries))
    column = max(range(z.shape[1]), key=lambda p: len(np.unique(candidates.z[:, p])))
    order = np.argsort(candidates.z[:, column], kind="stable")
    line = candidates.z[order, column]
    by_line = np.argsort(z[:, column], kind="stable")
    found = []
    for low in range(0, queries, 64):
        asked = by_line[low : low + 64]
        at = z[asked, column]
        # the k-th distance among some candidates close by bounds the k-th of all
        start = np.clip(np.searchsorted(line, at) - 4 * k, 0, size - 8 * k)
        near = order[start[:, None] + np.arange(8 * k)]
        gaps = z[asked][:, None, :] - candidates.z[near]
        differs = codes[:, asked][:, :, None] != candidates.codes[:, near]
        full = (gaps * gaps).sum(axis=2) + differs.sum(axis=0)
        reach = np.stack([np.partition(full - d, k - 1, axis=1)[:, k - 1] for d in differs], axis=1)
        reach = np.minimum(np.sqrt(reach), radius[asked]).max(axis=1) * (1.0 + 1e-9) + 1e-12
        stretch = order[np.searchsorted(line, (at - reach).min()) : np.searchsorted(line, (at + reach).max(), "right")]
        found.append(_search_all(candidates, stretch, z, codes, k, radius, asked))
    return tuple(np.concatenate(part) for part in zip(*found)) if found else _NOTHING


_NOTHING = tuple(np.empty(0, dtype=t) for t in (int, int, int, int, float))


def _search_all(
    candidates: _Candidates,
    among: np.ndarray,
    z: np.ndarray,
    codes: np.ndarray,
    k: int,
    radius: np.ndarray,
    asked: np.ndarray,
) -> tuple[np.ndarray, ...]:
    """Compare the ``asked`` queries with every candidate in ``among``."""
    found = []
    size, categories = len(among), len(candidates.words)
    their_z, their_codes, their_rows = candidates.z[among], candidates.codes[:, among], candidates.rows[among]
    step = max(1, CELLS_PER_STEP // max(1, size))
    for low in range(0, len(asked) if size else 0, step):
        own = asked[low : low + step]
        own_z, own_codes, wanted = z[own], codes[:, own], radius[own]
        square = np.zeros((len(own), size))
        for p in range(z.shape[1]):
            gap = own_z[:, p, None] - their_z[None, :, p]
            gap *= gap
            square += gap
        mismatches = np.zeros((len(own), size))
        for c in range(categories):
            mismatches += own_codes[c, :, None] != their_codes[c][None, :]
        # A target's squared distance is the full one less its own mismatch, at most 1: what is
        # near for any target is within 1 of the k-th in full distance (and of the radius).
        full = square + mismatches
        limit = np.minimum(_upper_bound(full, k), (wanted * wanted).max(axis=1))
        near = full <= (limit + 1.0 + 1e-9 * (1.0 + limit))[:, None]
        sparse = np.count_nonzero(near) * 16 < near.size
        query, place = np.nonzero(near) if sparse else (None, None)
        for target in range(categories):
            differs = own_codes[target, :, None] != their_codes[target][None, :]
            if sparse:
                at, to = query, place
                distance = np.sqrt(square[at, to] + (mismatches[at, to] - differs[at, to]))
            else:
                squared = square + (mismatches - differs)
                limit = np.minimum(_upper_bound(squared, k), wanted[:, target] ** 2)
                at, to = np.nonzero(squared <= (limit + 1e-9 * (1.0 + limit))[:, None])
                distance = np.sqrt(squared[at, to])
            kept = distance <= wanted[at, target]
            at, to, distance = at[kept], to[kept], distance[kept]
            order = np.lexsort((their_rows[to], distance, at))
            by_query = at[order]
            rank = np.arange(len(order)) - np.searchsorted(by_query, by_query)
            best, rank = order[rank < k], rank[rank < k]
            found.append((own[at[best]], np.full(len(best), target), rank + 1, among[to[best]], distance[best]))
    return tuple(np.concatenate(part) for part in zip(*found)) if found else _NOTHING


def _upper_bound(squared: np.ndarray, k: int) -> np.ndarray:
    """A value per row that at least k entries do not exceed, from every eighth of many."""
    some = squared[:, :: max(1, min(8, squared.shape[1] // (16 * k)))]
    if some.shape[1] <= k:
        return np.full(len(squared), np.inf)
    return np.partition(some, k - 1, axis=1)[:, k - 1]


def nearest_neighbours(
    seeds: DataFrame,
    seed_count: int,
    originals: DataFrame,
    numeric: int,
    categories: int,
    k: int = K_NEIGHBOURS,
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """Append ``neighbours`` to every synthetic row: k entries per target, nearest first.

    ``seeds`` holds ``i``, ``z`` and ``cats`` (of the seed row) next to any other columns;
    ``originals`` holds ``row_idx``, ``z`` and ``cats``.
    """
    text = F.aggregate("cats", F.lit(0), lambda n, c: n + F.coalesce(F.octet_length(c), F.lit(0)))
    width = 8 * (numeric + 1) + 12 * categories
    if strategy == "auto":
        size = originals.agg(F.sum(text + width).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
        small = (size["bytes"] or 0) <= broadcast_bytes and size["rows"] * seed_count <= BROADCAST_PAIRS
        strategy = "broadcast" if small else "blocked"
    if strategy == "broadcast":
        return _by_broadcast(seeds, seed_count, originals, categories, k)
    # views pay for many queries; they hold the originals once per category and more
    if categories <= MAX_VIEWED and seed_count * QUERIES_FOR_VIEWS >= originals.count():
        return _by_views(seeds, originals, numeric, categories, k, rows_per_block, queries_per_block)
    if seed_count <= MAX_SCANNED:
        seeds = cut_lineage(seeds)
        if (seeds.agg(F.sum(text + width)).first()[0] or 0) <= SCANNED_BYTES:
            return _by_scan(seeds, originals, categories, k)
    return _by_blocks(seeds, originals, numeric, categories, k, rows_per_block, queries_per_block)


def _by_scan(homes: DataFrame, originals: DataFrame, categories: int, k: int) -> DataFrame:
    spark = homes.sparkSession
    asked = homes.select("i", "z", "cats").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast((asked["i"].to_numpy(), _matrix(asked["z"], len(asked)), asked["cats"]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, z, cats = shared.value
        radius = np.full((len(i), categories), np.inf)
        # the nearest so far, in order of query and target: (query, target, distance, row), and the class
        best, classes = tuple(np.empty(0, dtype=t) for t in (int, int, float, np.int64)), np.empty(0, dtype=object)
        for block in _gathered(batches, ROWS_PER_SCAN):
            candidates = _Candidates.of(block, categories)
            # what is found for a level narrows the radius for the next
            for query, target, place, near in _levels(candidates, z, candidates.encode(cats), k, radius):
                words = candidates.texts(target, place).to_numpy(zero_copy_only=False)
                found = (query, target, near, candidates.rows[place])
                best, classes = tuple(map(np.concatenate, zip(best, found))), np.concatenate([classes, words])
                order = np.lexsort((best[3], best[2], best[1], best[0]))
                asks = best[0][order] * categories + best[1][order]
                rank = np.arange(len(order)) - np.searchsorted(asks, asks)
                kth = order[rank == k - 1]
                radius[best[0][kth], best[1][kth]] = best[2][kth]
                best, classes = tuple(x[order[rank < k]] for x in best), classes[order[rank < k]]
        if len(classes):
            query, target, near, row = best
            arrays = [pa.array(i[query], pa.int64()), pa.array(target, pa.int32()), pa.array(near), pa.array(row, pa.int64()), pa.array(classes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "target", "distance", ROW_INDEX, "class"])

    found = originals.select(ROW_INDEX, "z", "cats").mapInArrow(search, _PARTIAL_SCHEMA)
    entry = F.struct("target", "rank", ROW_INDEX, "distance", "class").cast(NEIGHBOUR_TYPE)
    lists = _top_k(found, k).groupBy("i").agg(F.sort_array(F.collect_list(entry)).alias("neighbours"))
    return homes.join(lists, "i", "left")


def _levels(
    candidates: _Candidates, z: np.ndarray, codes: np.ndarray, k: int, radius: np.ndarray
) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, target, candidate, distance) of at least the k nearest within the radius, by the number of categories that differ.

    The caller may narrow ``radius`` between the parts.
    """
    categories = len(codes)
    if categories > MAX_VIEWED:
        query, target, _, place, near = _search(candidates, z, codes, k, radius)
        yield query, target, place, near
        return
    for level in range(categories):
        asks = np.where(radius * radius * (1.0 + 1e-9) + 1e-9 >= level, radius, -1.0)
        found = []
        for shared in combinations(range(categories), categories - 1 - level):
            wanted = asks.copy()
            wanted[:, list(shared)] = -1.0
            own = np.nonzero((wanted >= 0).any(axis=1))[0]
            if len(own):
                view = sum(1 << c for c in shared)
                query, target, place, near = search_view(
                    candidates.rows, candidates.z, candidates.codes, z[own], codes[:, own], wanted[own], view, k
                )
                found.append((own[query], target, place, near))
        if found:
            yield tuple(map(np.concatenate, zip(*found)))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The first batch, which gives a first radius, then tables of at least as many rows until the last."""
    held, size, wanted = [], 0, 1
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= wanted:
            yield pa.Table.from_batches(held)
            held, size, wanted = [], 0, rows
    if size:
        yield pa.Table.from_batches(held)


def _by_broadcast(seeds: DataFrame, seed_count: int, originals: DataFrame, categories: int, k: int) -> DataFrame:
    spark = seeds.sparkSession
    table = originals.select(ROW_INDEX, "z", "cats").toArrow()
    gathered = _Candidates.of(table, categories)
    # plain arrays: what is broadcast must unpickle without this module
    shared = spark.sparkContext.broadcast((gathered.rows, gathered.z, gathered.codes, gathered.words))
    schema = T.StructType(
        [*seeds.schema.fields, T.StructField("neighbours", T.ArrayType(T._parse_datatype_string(NEIGHBOUR_TYPE)))]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates = _Candidates(*shared.value)
        for batch in batches:
            codes = candidates.encode(batch["cats"])
            query, target, rank, place, near = _search(candidates, _matrix(batch["z"], len(batch)), codes, k)
            order = np.lexsort((rank, target, query))
            query, target, rank, place, near = (x[order] for x in (query, target, rank, place, near))
            entries = pa.StructArray.from_arrays(
                [
                    pa.array(target, pa.int32()),
                    pa.array(rank, pa.int32()),
                    pa.array(candidates.rows[place], pa.int64()),
                    pa.array(near, pa.float64()),
                    candidates.texts(target, place),
                ],
                names=["target", "rank", "row_idx", "distance", "class"],
            )
            offsets = np.searchsorted(query, np.arange(len(batch) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "neighbours"])

    pairs = len(table) * seed_count
    tasks = max(spark.sparkContext.defaultParallelism, -(-pairs // PAIRS_PER_TASK))
    return seeds.repartition(tasks, "i").mapInArrow(search, schema)


def first_copies(originals: DataFrame, k: int, alike: list[str | Column] | None = None) -> DataFrame:
    """Only the first k of rows with equal features; the limit also applies before the shuffle."""
    same = Window.partitionBy(*(alike or ["z", "cats"])).orderBy(ROW_INDEX)
    return originals.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy")


def _top_k(partials: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("i", "target").orderBy("distance", ROW_INDEX)
    return partials.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


@dataclass
class _BlockTree:
    """Median cuts over (z-scores, category hashes), and the bounding boxes below each node.

    ``grouped``: the only hash is that of a view and of its categories; it is cut first, and another
    hash means out of reach.

    A complete binary tree in heap order: node n has children 2n and 2n + 1, the leaves are the
    blocks. Hash ranges only serve as bounds: a hash outside a block's range means another
    category, a hash inside says nothing.
    """

    depth: int
    numeric: int
    dims: np.ndarray
    cuts: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    sizes: np.ndarray | None = None
    grouped: bool = False

    @staticmethod
    def of(sample: np.ndarray, depth: int, numeric: int, grouped: bool = False) -> _BlockTree:
        inner = 1 << depth
        tree = _BlockTree(depth, numeric, np.zeros(inner, dtype=np.int32), np.full(inner, np.inf), grouped=grouped)
        categories = sample.shape[1] - numeric
        members = {1: np.arange(len(sample))}
        for node in range(1, inner):
            at = members.pop(node)
            points = sample[at]
            spread = np.zeros(sample.shape[1])
            if len(at) > 1:
                spread[:numeric] = points[:, :numeric].std(axis=0) * np.sqrt(12.0)
                # a category tells blocks apart for all targets but itself
                varied = points[:, numeric:].min(axis=0) < points[:, numeric:].max(axis=0)
                spread[numeric:] = np.where(varied, np.inf, 0.0) if grouped else varied * (categories - 1) / max(1, categories)
            dim = int(spread.argmax())
            right = np.zeros(len(at), dtype=bool)
            if spread[dim] > 0:
                values = points[:, dim]
                cut = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
                if cut == values.max():
                    cut = values[values < cut].max(initial=-np.inf)
                tree.dims[node], tree.cuts[node] = dim, cut
                right = values > cut
            members[2 * node], members[2 * node + 1] = at[~right], at[right]
        return tree

    def leaf(self, keys: np.ndarray) -> np.ndarray:
        node = np.ones(len(keys), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (keys[np.arange(len(keys)), self.dims[node]] > self.cuts[node])
        return node - (1 << self.depth)

    def beyond(self, keys: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) where a leaf other than the query's own is within the query's one radius, in a grouped tree."""
        node, margin = np.ones(len(keys), dtype=np.int64), np.full(len(keys), np.inf)
        for _ in range(self.depth):
            dim = self.dims[node]
            gap = keys[np.arange(len(keys)), dim] - self.cuts[node]
            margin = np.where(dim < self.numeric, np.minimum(margin, np.abs(gap)), margin)
            node = 2 * node + (gap > 0)
        # a radius that no cut on the way crosses stays in the own leaf
        crossed = np.nonzero(radius * (1.0 + 1e-9) + 1e-9 >= margin)[0]
        query, leaf, _ = self.within(keys[crossed], radius[crossed, None])
        away = leaf != node[crossed][query] - (1 << self.depth)
        return crossed[query[away]], leaf[away]

    def enclose(self, leaves: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> None:
        """Fill in bounding boxes: the leaves' own, and unions of both children above."""
        inner = 1 << self.depth
        self.low, self.high = np.full((2 * inner, low.shape[1]), np.inf), np.full((2 * inner, low.shape[1]), -np.inf)
        self.sizes = np.zeros(2 * inner, dtype=np.int64)
        self.low[inner + leaves], self.high[inner + leaves], self.sizes[inner + leaves] = low, high, sizes
        for node in range(inner - 1, 0, -1):
            self.low[node] = np.minimum(self.low[2 * node], self.low[2 * node + 1])
            self.high[node] = np.maximum(self.high[2 * node], self.high[2 * node + 1])
            self.sizes[node] = self.sizes[2 * node] + self.sizes[2 * node + 1]

    def within(self, keys: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, lower bound per target), where some bound is within its target's radius."""
        limit = radius * radius * (1.0 + 1e-9) + 1e-12  # rounding must not lose a tie
        query, node = np.arange(len(keys)), np.ones(len(keys), dtype=np.int64)
        for level in range(self.depth + 1):
            alive = self.sizes[node] > 0
            query, node = query[alive], node[alive]
            outside = np.maximum(self.low[node] - keys[query], keys[query] - self.high[node])
            gap = np.maximum(outside[:, : self.numeric], 0.0)
            miss = outside[:, self.numeric :] > 0
            bound = (gap * gap).sum(axis=1)[:, None] + miss.sum(axis=1)[:, None] - miss
            kept = (bound <= limit[query]).any(axis=1)
            if self.grouped:
                kept &= ~miss.any(axis=1)
            query, node, bound = query[kept], node[kept], bound[kept]
            if level < self.depth:
                query, node = np.repeat(query, 2), (2 * node[:, None] + np.arange(2)).ravel()
        return query, node - (1 << self.depth), bound

    def unvisited(self, batch: pa.RecordBatch, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs within reach and not visited yet: all, or the nearest per target."""
        query, leaf, bound = self.within(_matrix(batch["key"], len(batch)), _matrix(batch["radius"], len(batch)))
        visited = batch["visited"]
        seen = pc.list_parent_indices(visited).to_numpy() << self.depth | pc.list_flatten(visited).to_numpy()
        new = ~np.isin(query << self.depth | leaf, seen)
        query, leaf, bound = query[new], leaf[new], bound[new]
        if nearest is None:
            return query, leaf
        chosen = np.zeros(len(query), dtype=bool)
        for target in range(bound.shape[1]):
            order = np.lexsort((bound[:, target], query))
            by_query = query[order]
            chosen[order[np.arange(len(order)) - np.searchsorted(by_query, by_query) < nearest]] = True
        return query[chosen], leaf[chosen]


def _in_view(cats: str = "cats") -> Column:
    """The categories of a row that its view (a bit for each) shares; NULL for the others."""
    return F.expr(f"transform({cats}, (c, at) -> IF((view & shiftleft(1, at)) != 0, c, NULL))")


def _in_views(df: DataFrame, views: list[int]) -> DataFrame:
    """Each row once per view, with its block key: the z-scores and a hash of the view and its categories."""
    seen = df.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views])))
    return seen.withColumn("key", F.concat("z", F.array(F.xxhash64("view", _in_view()).cast("double"))))


def _by_views(
    seeds: DataFrame,
    originals: DataFrame,
    numeric: int,
    categories: int,
    k: int,
    rows_per_block: int,
    queries_per_block: int,
) -> DataFrame:
    homes, rows = cut_lineage(seeds), cut_lineage(originals.select(ROW_INDEX, "z", "cats"))
    asked = homes.select("i", "z", "cats")
    best, unbounded = None, F.array(*[F.lit(float("inf"))] * categories)
    for level in range(categories):
        views = [sum(1 << c for c in shared) for shared in combinations(range(categories), categories - 1 - level)]
        if best is None:
            queries = asked.withColumn("radius", unbounded)
        else:
            queries = asked.join(_reach(best, categories, k), "i", "left").withColumn("radius", F.coalesce("radius", unbounded))
            # whose k-th neighbours for all targets are nearer than the level is done
            queries = cut_lineage(queries.where(F.exists("radius", lambda r: r * r * (1.0 + 1e-9) + 1e-9 >= level)))
            if queries.isEmpty():
                break
        best = _search_level(queries, rows, views, level, numeric, categories, k, best, rows_per_block, queries_per_block)
    entry = F.struct("target", "rank", ROW_INDEX, "distance", "class").cast(NEIGHBOUR_TYPE)
    lists = best.groupBy("i").agg(F.sort_array(F.collect_list(entry)).alias("neighbours"))
    return homes.join(lists, "i", "left")


def _reach(best: DataFrame, categories: int, k: int) -> DataFrame:
    """The k-th distance per query and target so far, infinite while there are fewer."""
    kth = [
        F.when(F.count_if(F.col("target") == t) >= k, F.max(F.when(F.col("target") == t, F.col("distance"))))
        for t in range(categories)
    ]
    return best.groupBy("i").agg(F.array(*[F.coalesce(r, F.lit(float("inf"))) for r in kth]).alias("radius"))


def _search_level(
    queries: DataFrame,
    rows: DataFrame,
    views: list[int],
    level: int,
    numeric: int,
    categories: int,
    k: int,
    before: DataFrame | None,
    rows_per_block: int,
    queries_per_block: int,
) -> DataFrame:
    """The nearest rows that differ in ``level`` categories but the target, within each query's radius, ranked with those ``before``."""
    spark = rows.sparkSession
    keyed = _in_views(rows, views)
    size = keyed.agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("key")).alias("distinct")
    ).first()
    row_bytes = 8 * (numeric + 1)
    most = min(MAX_BLOCKS, DRIVER_BYTES // (8 * row_bytes))
    blocks = max(1, min(most, -(-min(size["rows"], k * size["distinct"]) // rows_per_block)))
    depth = (blocks - 1).bit_length()
    wanted = min(DRIVER_BYTES // (2 * row_bytes), _SAMPLE_PER_BLOCK << depth)
    # the sample only places the cuts; its size is bounded by the number of blocks
    drawn = keyed.sample(min(1.0, wanted / max(1, size["rows"])), seed=29).select("key").toArrow()
    sample = np.unique(_matrix(drawn["key"], len(drawn)).reshape(len(drawn), numeric + 1), axis=0)
    tree = _BlockTree.of(sample, depth, numeric, grouped=True)
    cuts = spark.sparkContext.broadcast((tree.depth, tree.numeric, tree.dims, tree.cuts))

    @F.arrow_udf(T.LongType())
    def leaf_of(key: pa.Array) -> pa.Array:
        return pa.array(_BlockTree(*cuts.value).leaf(_matrix(key, len(key))), pa.int64())

    placed = cut_lineage(keyed.withColumn("leaf", leaf_of("key")))
    boxes = _boxes(placed, numeric + 1)
    leaves, sizes = boxes["leaf"].to_numpy(), boxes["size"].to_numpy().copy()
    tree.enclose(leaves, _matrix(boxes["low"], len(boxes)), _matrix(boxes["high"], len(boxes)), sizes)
    shared = spark.sparkContext.broadcast((tree.depth, tree.numeric, tree.dims, tree.cuts, tree.low, tree.high, tree.sizes))
    # rows alike in z-scores and in the view's categories are at one distance: the first k do
    placed, sizes = _thin_out(placed, leaves, sizes, 4 * rows_per_block, k, ["view", "z", _in_view()])
    parts = np.maximum(1, -(-sizes // (8 * rows_per_block)))

    def within_views(candidates: _Candidates, left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        z, codes = _matrix(left["z"], len(left)), candidates.encode(left["cats"])
        radius, views = _matrix(left["radius"], len(left)), left["view"].to_numpy()
        theirs, found = right["o_view"].to_numpy(), [tuple(_NOTHING[at] for at in (0, 1, 3, 4))]  # a part may have no queries
        for view in np.unique(views):
            own, held = np.nonzero(views == view)[0], np.nonzero(theirs == view)[0]
            query, target, place, near = search_view(
                candidates.rows[held], candidates.z[held], candidates.codes[:, held], z[own], codes[:, own], radius[own], int(view), k
            )
            found.append((own[query], target, held[place], near))
        return tuple(np.concatenate(part) for part in zip(*found))

    def search(visits: DataFrame) -> DataFrame:
        found = _search_blocks(visits, placed, (leaves, sizes, parts), categories, k, queries_per_block, ["view"], within_views)
        return spark.createDataFrame([], _PARTIAL_SCHEMA) if found is None else found

    # a radius less than the level, or of a target that the view shares, asks for nothing
    asks = f"transform(radius, (r, t) -> IF((view & shiftleft(1, t)) != 0 OR r * r * (1.0D + 1e-9D) + 1e-9D < {level}, -1.0D, r))"

    def viewed(queries: DataFrame) -> DataFrame:
        seen = _in_views(queries, views).withColumn("radius", F.expr(asks))
        return seen.where(F.exists("radius", lambda r: r >= 0))

    best = search(viewed(queries).withColumn("leaf", leaf_of("key")))
    if before is not None:
        best = best.unionByName(before.drop("rank"))
    # on the first level a target has one view, and a block that is searched whole gives its k nearest at once
    best = cut_lineage(best if before is None and not (parts > 1).any() else _top_k(best, k).drop("rank"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = _BlockTree(*shared.value, grouped=True)
        step = max(1, min(1024, CELLS_PER_STEP >> boxes.depth))  # even if every block is in reach
        for batch in batches:
            for low in range(0, len(batch), step):
                piece = batch.slice(low, step)
                keys, radius = _matrix(piece["key"], len(piece)), _matrix(piece["radius"], len(piece))
                square = np.where(radius >= 0, radius * radius, 0.0).max(axis=1) - level
                query, leaf = boxes.beyond(keys, np.sqrt(np.maximum(square, 0.0) + 1e-9 * (1.0 + level)))
                kept = piece.select(["i", "z", "cats", "radius", "view"]).take(pa.array(query))
                yield kept.append_column("leaf", pa.array(leaf, pa.int64()))

    # a fixed number of tasks: few bytes per query, but much work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nearer = queries.select("i", "z", "cats").repartition(tasks, "i").join(_reach(best, categories, k), "i", "left")
    nearer = nearer.withColumn("radius", F.coalesce("radius", F.array(*[F.lit(float("inf"))] * categories)))
    visits = viewed(nearer).select("i", "z", "cats", "radius", "view", "key").mapInArrow(route, _VIEW_SCHEMA)
    found = search(cut_lineage(visits))
    return cut_lineage(_top_k(best.unionByName(found), k))


def _by_blocks(
    seeds: DataFrame,
    originals: DataFrame,
    numeric: int,
    categories: int,
    k: int,
    rows_per_block: int,
    queries_per_block: int,
) -> DataFrame:
    spark = seeds.sparkSession
    hashes = F.transform("cats", lambda c: F.xxhash64(c).cast("double"))
    keyed = originals.select(ROW_INDEX, "z", "cats", F.concat("z", hashes).alias("key"))

    size = keyed.agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("z", "cats")).alias("distinct")
    ).first()
    row_bytes = 8 * (numeric + categories)
    most = min(MAX_BLOCKS, DRIVER_BYTES // (8 * row_bytes))  # low and high of a block, in tree and table
    blocks = max(1, min(most, -(-min(size["rows"], k * size["distinct"]) // rows_per_block)))
    depth = (blocks - 1).bit_length()
    wanted = min(DRIVER_BYTES // (2 * row_bytes), _SAMPLE_PER_BLOCK << depth)
    # the sample only places the cuts; its size is bounded by the number of blocks
    drawn = keyed.sample(min(1.0, wanted / max(1, size["rows"])), seed=29).select("key").toArrow()
    sample = np.unique(_matrix(drawn["key"], len(drawn)).reshape(len(drawn), numeric + categories), axis=0)
    tree = _BlockTree.of(sample, depth, numeric)
    cuts = spark.sparkContext.broadcast((tree.depth, tree.numeric, tree.dims, tree.cuts))

    @F.arrow_udf(T.LongType())
    def leaf_of(key: pa.Array) -> pa.Array:
        return pa.array(_BlockTree(*cuts.value).leaf(_matrix(key, len(key))), pa.int64())

    placed = cut_lineage(keyed.withColumn("leaf", leaf_of("key")))
    boxes = _boxes(placed, numeric + categories)
    leaves, sizes = boxes["leaf"].to_numpy(), boxes["size"].to_numpy().copy()
    tree.enclose(leaves, _matrix(boxes["low"], len(boxes)), _matrix(boxes["high"], len(boxes)), sizes)
    shared = spark.sparkContext.broadcast(
        (tree.depth, tree.numeric, tree.dims, tree.cuts, tree.low, tree.high, tree.sizes)
    )
    placed, sizes = _thin_out(placed, leaves, sizes, 4 * rows_per_block, k)
    parts = np.maximum(1, -(-sizes // (8 * rows_per_block)))

    def search(visits: DataFrame) -> DataFrame | None:
        return _search_blocks(visits, placed, (leaves, sizes, parts), categories, k, queries_per_block)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unbounded = F.array(*[F.lit(float("inf"))] * categories)
    homes = cut_lineage(seeds.withColumn("key", F.concat("z", hashes)).withColumn("leaf", leaf_of("key")))
    best = search(homes.withColumn("radius", unbounded))
    if best is None:  # every query falls where no original is
        best = spark.createDataFrame([], _PARTIAL_SCHEMA)
    # a block that is searched whole gives a query's k nearest at once
    best = cut_lineage(_top_k(best, k).drop("rank") if (parts > 1).any() else best)

    def route(nearest: int | None):
        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boxes = _BlockTree(*shared.value)
            step = max(1, min(1024, CELLS_PER_STEP >> boxes.depth))  # even if every block is in reach
            for batch in batches:
                for low in range(0, len(batch), step):
                    piece = batch.slice(low, step)
                    query, leaf = boxes.unvisited(piece, nearest)
                    kept = piece.select(["i", "z", "cats", "radius"]).take(pa.array(query))
                    yield kept.append_column("leaf", pa.array(leaf, pa.int64()))

        return routed

    def visits(best: DataFrame, nearby: DataFrame | None, nearest: int | None) -> DataFrame:
        # a fixed number of tasks: few bytes per query, but much work
        queries = homes.repartition(tasks, "i").join(_reach(best, categories, k), "i", "left")
        visited = F.array("leaf")
        if nearby is not None:
            queries = queries.join(nearby.groupBy("i").agg(F.collect_list("leaf").alias("nearby")), "i", "left")
            visited = F.concat(visited, F.coalesce("nearby", F.array().cast("array<bigint>")))
        asked = queries.select("i", "z", "cats", "key", F.coalesce("radius", unbounded).alias("radius"), visited.alias("visited"))
        return cut_lineage(asked.mapInArrow(route(nearest), _VISIT_SCHEMA))

    nearby = None
    if blocks >= _TIGHTEN_FROM:
        # a few nearby blocks first: they tighten the radius, and with it the number in reach
        nearby = visits(best, None, _NEARBY_BLOCKS)
        found = search(nearby)
        if found is not None:
            best = cut_lineage(_top_k(best.unionByName(found), k).drop("rank"))
    found = search(visits(best, nearby, None))
    best = _top_k(best if found is None else best.unionByName(found), k)
    entry = F.struct("target", "rank", ROW_INDEX, "distance", "class").cast(NEIGHBOUR_TYPE)
    lists = best.groupBy("i").agg(F.sort_array(F.collect_list(entry)).alias("neighbours"))
    return homes.drop("key", "leaf").join(lists, "i", "left")


def _boxes(placed: DataFrame, dims: int) -> pa.Table:
    """Size and bounding box per block: one row each, MAX_BLOCKS at most."""
    return (
        placed.groupBy("leaf")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.array(*[F.min(F.col("key")[d]) for d in range(dims)]).alias("low"),
            F.array(*[F.max(F.col("key")[d]) for d in range(dims)]).alias("high"),
        )
        .orderBy("leaf")
        .toArrow()
    )


def _thin_out(
    placed: DataFrame, leaves: np.ndarray, sizes: np.ndarray, limit: int, k: int, alike: list[str | Column] | None = None
) -> tuple[DataFrame, np.ndarray]:
    """Keep the first k copies of equal rows, in the blocks that are far too large.

    Cuts even out different rows, so only copies make a block so large. The other blocks, as a
    rule all of them, are left alone: no shuffle of the whole table.
    """
    rows = placed.drop("key")
    large = sizes > limit
    if not large.any():
        return rows, sizes
    hot = F.broadcast(placed.sparkSession.createDataFrame(pa.table({"leaf": leaves[large]})))
    thinned = cut_lineage(first_copies(rows.join(hot, "leaf", "left_semi"), k, alike))
    left = thinned.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).toArrow()
    sizes[np.searchsorted(leaves, left["leaf"].to_numpy())] = left["size"].to_numpy()
    return rows.join(hot, "leaf", "left_anti").unionByName(thinned), sizes


def _search_blocks(
    visits: DataFrame,
    placed: DataFrame,
    blocks: tuple[np.ndarray, np.ndarray, np.ndarray],
    categories: int,
    k: int,
    queries_per_block: int,
    more: list[str] | None = None,
    within: Callable[[_Candidates, pa.Table, pa.Table], tuple[np.ndarray, ...]] | None = None,
) -> DataFrame | None:
    """The k nearest per query inside each visited block; None when no block is visited.

    ``within`` finds (query, target, candidate, distance) in a block in another way than by all
    categories; it sees the ``more`` columns of both sides too.

    ``blocks`` gives leaf, size and number of parts of every block, in leaf order. A block with many
    rows is cut into parts, which all its queries visit; a block with many queries gets several
    chunks of queries, each with its own copy of the (bounded) part. Blocks nobody visits are
    dropped before the shuffle. The driver counts the queries per block: one row a block.
    """
    more = more or []
    leaves, sizes, parts = blocks
    load = visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("queries")).toArrow()
    asked, queries = load["leaf"].to_numpy(), load["queries"].to_numpy()
    held = np.isin(asked, leaves)
    asked, queries = asked[held], queries[held]
    if not len(asked):
        return None
    at = np.searchsorted(leaves, asked)
    chunks = -(-queries // queries_per_block)
    plan = F.broadcast(placed.sparkSession.createDataFrame(pa.table({"leaf": asked, "parts": parts[at], "chunks": chunks})))
    pairs = int((queries * sizes[at]).sum())
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS_PER_TASK))

    queries = (
        visits.join(plan, "leaf")
        .withColumn("chunk", F.pmod(F.xxhash64("i"), "chunks"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select("i", "z", "cats", "radius", *more, *_BLOCK_KEYS)
        .repartition(tasks, *_BLOCK_KEYS)
    )
    rows = (
        placed.join(plan, "leaf")
        .withColumn("part", F.pmod(F.xxhash64(ROW_INDEX), "parts"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        # new names: both sides can descend from the same original columns
        .select(*[F.col(c).alias(f"o_{c}") for c in (ROW_INDEX, "z", "cats", *more)], *_BLOCK_KEYS)
        .repartition(tasks, *_BLOCK_KEYS)
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = right.select([f"o_{ROW_INDEX}", "o_z", "o_cats"]).rename_columns([ROW_INDEX, "z", "cats"])
        candidates = _Candidates.of(columns, categories)
        if within is not None:
            query, target, place, near = within(candidates, left, right)
        else:
            z, codes = _matrix(left["z"], len(left)), candidates.encode(left["cats"])
            query, target, _, place, near = _search(candidates, z, codes, k, _matrix(left["radius"], len(left)))
        return pa.table(
            {
                "i": left["i"].combine_chunks().take(pa.array(query)),
                "target": pa.array(target, pa.int32()),
                "distance": pa.array(near, pa.float64()),
                "row_idx": pa.array(candidates.rows[place], pa.int64()),
                "class": candidates.texts(target, place),
            }
        )

    grouped = queries.groupBy(*_BLOCK_KEYS).cogroup(rows.groupBy(*_BLOCK_KEYS))
    return grouped.applyInArrow(search, _PARTIAL_SCHEMA)


def classes_of(target: int) -> Column:
    """The class votes of one target, nearest first."""
    own = F.filter("neighbours", lambda n: n["target"] == target)
    return F.transform(own, lambda n: n["class"])


def neighbour_votes(found: DataFrame, names: list[str]) -> DataFrame:
    """Votes per class and target, with the rank at which a class is first seen."""
    entries = found.select("i", F.inline("neighbours"))
    return entries.groupBy(
        "i", F.get(F.array(*[F.lit(n) for n in names]), "target").alias("target"), "class"
    ).agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first_rank"))
