"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ``n`` items of one block with links ``a``-``b``: the smallest item that each is connected to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b), the component being its smallest node.

    Alternates large-star and small-star steps (every node's larger neighbours, then its smaller ones, are linked to its smallest neighbour) until nothing changes. Each step only groups and joins, so a hub's neighbours are never gathered in one task.
    """
    now = checkpoint(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))
    last = tuple(now.agg(*mark).first())
    for _ in range(rounds):
        if not last[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        mark_now = tuple(now.agg(*mark).first())
        if mark_now == last:
            break
        last = mark_now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
