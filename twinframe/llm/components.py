"""Connected components by alternating large-star and small-star rounds.

Every round keeps one edge row per node and neighbour and hangs nodes on the smallest neighbour
they know. Minima are taken with partial aggregation, written, and joined back, so a node with
very many edges is never gathered in one task. Each round's edges go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import cut_lineage


def _hang(edges: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and its listed neighbours as ``m``."""
    least = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to (node, root): the smallest node reachable, for every node with an edge to another one."""
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = now.union(now.select("v", "u"))
        large = cut_lineage(_hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        hung = _hang(large)
        now = cut_lineage(hung.select("v", "m").union(hung.select("u", "m")).toDF("u", "v").where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = mark
