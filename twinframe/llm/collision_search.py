"""Nearest neighbours by counting collisions on single projections.

Vectors are dealt into blocks of bounded size. A block keeps one sorted array per random
projection. A query looks at the window around its own value in every array and widens all
windows step by step (virtual rehashing); only the newly covered stretches are counted. A vector
in the windows of at least ``THRESHOLD`` of the arrays is verified with its true distance. The
search ends when, at the present width, a vector as near as the k-th best so far would have
passed the threshold with a chance of about 98 %. Blocks hold every row; there is no sample.

Queries are a stated set and visit every block; within a block they stream past the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECTIONS = 64
THRESHOLD = 32
WIDEN = 1.25
BLOCK_ROWS = 16_384  # at most, on average
LEAST_ROWS = 512  # blocks aren't made smaller to have one for every task
# windows of half width BOUND * d hold a vector at distance d in 40 of 64 projections on average, two deviations above the threshold
BOUND = 0.887


class Block:
    """The sorted projections of a block; copies of a vector are one entry with ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5) -> None:
        distinct, entry = np.unique(vectors, axis=0, return_inverse=True)
        entry = entry.ravel()
        order = np.lexsort((ids, entry))
        self.vectors = distinct
        self.ids = ids[order]
        self.bounds = np.searchsorted(entry[order], np.arange(len(distinct) + 1))
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], PROJECTIONS))
        values = (distinct @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.spread = float((self.values[:, -1] - self.values[:, 0]).max()) or 1.0

    def nearest(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest rows found, ties by id; the query's own id takes no part."""
        n = len(self.vectors)
        centre = query @ self.directions
        counts = np.zeros(n, dtype=np.int32)
        verified = np.zeros(n, dtype=bool)
        # the first windows hold about 1 in 128 of the entries
        middle = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre)])
        low, high = middle.copy(), middle.copy()
        step = max(1, n // 256)
        ahead = np.abs(self.values[np.arange(PROJECTIONS), np.minimum(middle + step, n - 1)] - centre)
        width = max(float(np.median(ahead)), self.spread * 1e-9)
        best: list[tuple[float, int]] = []
        while True:
            fresh = []
            for j, (values, order, c) in enumerate(zip(self.values, self.order, centre.tolist())):
                a, b = values.searchsorted(c - width), values.searchsorted(c + width, "right")
                if a < low[j]:
                    fresh.append(order[a : low[j]])
                    low[j] = a
                if b > high[j]:
                    fresh.append(order[high[j] : b])
                    high[j] = b
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int32)
            passed = np.flatnonzero((counts >= THRESHOLD) & ~verified)
            if len(passed):
                verified[passed] = True
                apart = np.sqrt(((self.vectors[passed] - query) ** 2).sum(axis=1))
                near = apart <= best[-1][0] if len(best) >= k else np.ones(len(passed), dtype=bool)
                for at, d in zip(passed[near].tolist(), apart[near].tolist()):
                    # of a vector's copies no more than the first k ids (and the query's own) can matter
                    own = self.ids[self.bounds[at] : min(self.bounds[at + 1], self.bounds[at] + k + 1)]
                    best += [(d, i) for i in own.tolist() if i != query_id]
                best = sorted(best)[:k]
            if len(best) >= k and width >= BOUND * best[-1][0] or (low == 0).all() and (high == n).all():
                return best
            width *= WIDEN


def usable(vector: Column) -> Column:
    """Not NULL, not empty, all components finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest_neighbours(df: DataFrame, k: int = 10, every: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found to every row whose id is divisible by ``every``.

    Nearness is the Euclidean distance in double precision; ties go to the smaller id. Rows with
    a NULL id and vectors that are NULL, zero, or hold NULL or non-finite components take no
    part; vectors of another length than the query's are no candidates. Rows that share the
    query's id are its own; rows that share another id are candidates each. Of several query
    rows with one id, one is asked. Other columns are ignored.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    n = rows.count()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n / block_rows), min(tasks, math.ceil(n / LEAST_ROWS)))
    data = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("v").alias("dim"), F.lit(1).alias("asks"), "vec_id", "v")
    ordered = data.unionByName(asked).repartition("block", "dim").sortWithinPartitions("block", "dim", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        at, index = None, None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("block", "dim", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                block, dim, asks = keys[a].tolist()
                if (block, dim) != at:
                    at, index, ids, vectors = (block, dim), None, [], []
                own = batch.column("vec_id").slice(a, b - a).to_numpy()
                values = batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dim)
                if not asks:
                    ids.append(own)
                    vectors.append(values)
                    continue
                if index is None and ids:
                    index = Block(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [], []
                if index is not None:
                    for query_id, query in zip(own.tolist(), values):
                        out += [(query_id, i, d) for d, i in index.nearest(query, query_id, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = ordered.mapInArrow(run, "query_id long, vec_id long, score double")
    # every block gives k rows at most, so a query gathers k rows a block
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))

