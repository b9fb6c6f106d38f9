"""Connected components of a graph given as links, by alternating stars.

Each round points every node of a star at the smallest node known there, first
for larger neighbours, then for smaller ones; the rounds needed grow with the
logarithm of the longest path. A star's smallest node is found by aggregation
(combined before the shuffle) and joined back, so a hub with very many links is
never collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import durable


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, smallest node) that connect what the links ``a - b`` connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``, long) that is not its component's smallest.

    Nulls and self-links are dropped; links may repeat and point either way.
    An empty table gives no rows.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = durable(pairs)
    count, digest = -1, None
    while True:
        # Large star: a node's larger neighbours, and itself, point at its smallest neighbour or itself.
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node's smaller neighbours, and itself, point at the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = durable(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (now[0], now[1]) == (count, digest):
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        count, digest = now[0], now[1]
