"""Problem 2: consolidating pairwise links into groups.

Union-find runs within bounded edge partitions; each keeps only its spanning
forest, written as (node, root) stars. Where several partitions give one node
different roots, the roots are linked, and those links are the edges of the
next, smaller level. Every level places its edges by a hash order of its own:
an edge lies with the end that comes first in that order, so a path, however
its ids are strided, loses a fixed share of its edges a level and levels grow
with the logarithm of the edges; equal ends are cut further by the other end,
so a node with a third of all edges is spread. A level has as many partitions
as its edges need at ``edges_per_partition`` each, so no task holds more than
that; the level that fits one partition is the last. Labels are then handed
back down.

Each level shuffles its star forest by node once, ids only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

STAR = "node long, root long"


def union_find(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and each node's root, the smallest node of its tree."""
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))
    half = len(left)
    for a, b in zip(inverse[:half].tolist(), inverse[half:].tolist()):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i, up in enumerate(parent):  # parents are smaller, so they are final already
        parent[i] = parent[up]
    return nodes, nodes[np.asarray(parent, dtype=np.int64)] if len(nodes) else nodes


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right = [], []
    for batch in batches:
        left.append(batch.column(0).to_numpy(zero_copy_only=False))
        right.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not left:
        return
    nodes, roots = union_find(np.concatenate(left), np.concatenate(right))
    step = 1 << 16
    for i in range(0, len(nodes), step):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + step]), pa.array(roots[i : i + step])], names=["node", "root"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", edges_per_partition: int = 500_000, least_edges: int = 20_000) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node id of its component.

    ``left`` and ``right`` are bigint columns; further columns are ignored.
    Edges with a null end link nothing. An edge of a node with itself makes a
    component of one node. Repeated edges count once. An empty input gives an
    empty result. A level has a partition a core, but none of fewer than
    ``least_edges`` nor of more than ``edges_per_partition`` edges.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    level = cut(edges.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    cores = edges.sparkSession.sparkContext.defaultParallelism
    least_edges = min(least_edges, edges_per_partition)
    stars: list[DataFrame] = []
    while True:
        count = level.count()
        parts = max(1, math.ceil(count / edges_per_partition), min(cores, count // least_edges))
        if parts == 1:
            stars.append(level.coalesce(1).mapInArrow(_forest, STAR))
            break
        place = lambda c: F.xxhash64(c, F.lit(len(stars)))
        ends = level.select("u", "v", place("u").alias("hu"), place("v").alias("hv"))
        spread = ends.repartitionByRange(parts, F.least("hu", "hv"), F.greatest("hu", "hv")).select("u", "v")
        forest = spread.mapInArrow(_forest, STAR).groupBy("node", "root").agg(F.lit(1).alias("one"))
        low = forest.withColumn("low", F.min("root").over(W.partitionBy("node")))  # a node has at most a row a partition
        low = cut(low.select("node", "root", "low"))
        stars.append(low.where("root = low").select("node", "root"))
        level = cut(low.where("root <> low").select(F.col("low").alias("u"), F.col("root").alias("v")).distinct())
    labels = stars.pop()
    while stars:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = stars.pop().join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return labels


def levels_of(edges: list[tuple[int, int]], parts_of) -> int:
    """The number of levels that edges take, replayed in memory; ``parts_of`` gives a level's partitions by its edges."""
    count = 0
    while True:
        count += 1
        parts = parts_of(len(edges))
        if parts <= 1 or not edges:
            return count
        mark = lambda x: hash((x, count, 0x9E3779B9)) & 0xFFFFFFFF
        ordered = sorted(edges, key=lambda e: tuple(sorted((mark(e[0]), mark(e[1])))))
        step = math.ceil(len(ordered) / parts)
        roots: dict[int, set[int]] = {}
        for i in range(0, len(ordered), step):
            u, v = map(np.asarray, zip(*ordered[i : i + step]))
            for node, root in zip(*map(np.ndarray.tolist, union_find(u, v))):
                roots.setdefault(node, set()).add(root)
        edges = list({(min(r), x) for r in roots.values() for x in r if x != min(r)})
