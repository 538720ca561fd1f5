"""Connected components of a link table.

Up to ``ONE_TASK`` links, 16 bytes each, are joined up in one task by union-find. More go through
alternating large and small stars: each round rewires links to smaller neighbours with two
aggregations and two joins. Neighbour lists are never gathered, so a node of any degree is only a
skewed join key, and rounds grow with the logarithm of the longest path. Both give the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import drop_stash, stash


ONE_TASK = 1_000_000


def components(nodes: DataFrame, links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, grp) for every node: the smallest node that links (a, b) lead to."""
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    leaf = _union_find(ends) if links.count() <= one_task else _stars(ends)
    return stash(nodes.select("node").distinct().join(leaf, "node", "left").select("node", F.coalesce("grp", "node").alias("grp")), "groups")


def _union_find(ends: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
                up.setdefault(u, u)
                up.setdefault(v, v)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "grp"])

    return ends.repartition(1).mapInArrow(run, "node bigint, grp bigint")


def _stars(ends: DataFrame) -> DataFrame:
    edges, state = None, None
    fresh = ends.distinct()
    while True:
        new = stash(fresh, "components")
        if edges is not None:
            drop_stash(edges)
        edges = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first())
        if now == state or now[0] == 0:
            break
        state = now
        fresh = _small_star(_large_star(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("grp"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
