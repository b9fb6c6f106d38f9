"""Nearest neighbours by vantage-point trees, one for each shard.

Vectors are dealt to shards of bounded size; each shard becomes one row that
holds its tree. Every query is sent to every shard, where the queries stream
past the tree, which is held once. A block of them descends
the tree together: at each node the queries visit their own side first, then the
other side unless the triangle inequality rules it out. The bound is relaxed
by ``factor``: the other side is skipped where the distance to the boundary
exceeds ``factor`` times the distance of the worst neighbour so far. One is
exact search; smaller factors visit less and may miss neighbours.

No task holds more than a shard and a block of queries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
COPY_QUERIES = 1 << 17  # queries that stream past one copy of a tree
FACTOR = 0.17


def usable(embedding: Column) -> Column:
    """Whether a vector is finite, without nulls and not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def distances(queries: np.ndarray, vectors: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances in double precision, each summed alike.

    Pairs farther apart than ``most`` of the query (by the inner product, with
    room for its rounding) are infinite; the others are exact.
    """
    out = np.full((len(queries), len(vectors)), np.inf)
    if most is None or np.isinf(most).any():
        i, j = (x.ravel() for x in np.indices(out.shape))
    else:
        a, b = np.einsum("ij,ij->i", queries, queries)[:, None], np.einsum("ij,ij->i", vectors, vectors)[None, :]
        i, j = np.nonzero(a + b - 2 * (queries @ vectors.T) <= (most**2)[:, None] + 1e-9 * (a + b))
    gap = vectors[j] - queries[i]
    out[i, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


class Tree:
    """A vantage-point tree over the rows of a matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 42) -> None:
        self.order = np.argsort(ids, kind="stable")
        self.nodes: list[tuple] = []  # (lo, hi, radius, inner, outer); a leaf has no inner
        self.leaf, rng = leaf, np.random.default_rng(seed)
        points = vectors.astype(np.float64)

        def build(lo: int, hi: int) -> int:
            at = len(self.nodes)
            self.nodes.append((lo, hi, 0.0, -1, -1))
            if hi - lo <= leaf:
                return at
            pick = int(rng.integers(lo, hi))
            self.order[[lo, pick]] = self.order[[pick, lo]]
            rest = self.order[lo + 1 : hi]
            d = distances(points[self.order[lo : lo + 1]], points[rest])[0]
            by = np.argsort(d, kind="stable")
            half = len(rest) // 2
            self.order[lo + 1 : hi] = rest[by]
            radius, mid = float(d[by[half]]), lo + 1 + half
            self.nodes[at] = (lo, hi, radius, build(lo + 1, mid), build(mid, hi))
            return at

        if len(ids):
            build(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest found of each query: distances and ids (-1: fewer), without the query's own id."""
        best = np.full((len(queries), k), np.inf)
        names = np.full((len(queries), k), np.iinfo(np.int64).max)
        points = self.vectors.astype(np.float64)

        def offer(active: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
            d = np.where(query_ids[active][:, None] == ids[None, :], np.inf, d)
            better = (d <= best[active, -1][:, None]).any(axis=1)
            active, d = active[better], d[better]
            if not len(active):
                return
            all_d = np.concatenate([best[active], d], axis=1)
            all_ids = np.concatenate([names[active], np.broadcast_to(ids, d.shape)], axis=1)
            all_ids = np.where(np.isinf(all_d), np.iinfo(np.int64).max, all_ids)
            first = np.lexsort((all_ids, all_d), axis=1)[:, :k]
            best[active], names[active] = np.take_along_axis(all_d, first, 1), np.take_along_axis(all_ids, first, 1)

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            lo, hi, radius, inner, outer = self.nodes[node]
            if inner < 0:
                offer(active, distances(queries[active], points[lo:hi], best[active, -1]), self.ids[lo:hi])
                return
            d = distances(queries[active], points[lo : lo + 1])[:, 0]
            offer(active, d[:, None], self.ids[lo : lo + 1])
            inside = d < radius
            visit(inner, active[inside])
            visit(outer, active[~inside])
            open_ = np.abs(d - radius) <= factor * best[active, -1]
            visit(outer, active[inside & open_])
            visit(inner, active[~inside & open_])

        if self.nodes:
            visit(0, np.arange(len(queries)))
        return best, np.where(np.isinf(best), -1, names)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found, nearest first.

    Both tables have ``vec_id`` and ``embedding``. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do rows with a
    null id; vectors of another length than the query's are no candidates. Rows
    with the query's own id are left out. Ties go to the smaller id; rows that
    repeat are candidates each. A query that repeats is asked once; of several
    vectors under one id the smallest is asked. Empty tables give no rows; other
    columns, clashing or not, are ignored.
    """
    def slim(t: DataFrame) -> DataFrame:
        t = t.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dims"))

    rows = slim(vectors)
    asked = slim(queries).groupBy("vec_id").agg(F.min(F.struct("dims", "embedding")).alias("q")).select("vec_id", "q.dims", "q.embedding")
    shards = max(1, -(-rows.count() // shard_rows))
    copies = max(1, -(-asked.count() // COPY_QUERIES))

    def plant(batch: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(batch["vec_id"].to_numpy(np.int64), np.stack(batch["embedding"]))
        return pd.DataFrame({"dims": batch["dims"].iloc[:1], "shard": batch["shard"].iloc[:1], "tree": [pickle.dumps(tree, protocol=5)]})

    def hunt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for batch in batches:
            at = list(zip(batch["dims"].tolist(), batch["shard"].tolist(), batch["copy"].tolist(), strict=True))
            trees = batch["tree"].notna().to_numpy()
            cuts = sorted({0, len(batch), *np.flatnonzero(trees).tolist(), *(np.flatnonzero(trees) + 1).tolist(), *(i for i in range(1, len(at)) if at[i] != at[i - 1])})
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if trees[lo]:
                    held = at[lo], pickle.loads(batch["tree"].iloc[lo])
                elif held is not None and held[0] == at[lo]:  # else no vector of this length lies in the shard
                    for start in range(lo, hi, block_queries):
                        part = batch.iloc[start : min(start + block_queries, hi)]
                        ids = part["vec_id"].to_numpy(np.int64)
                        best, names = held[1].search(ids, np.stack(part["embedding"]).astype(np.float64), k, factor)
                        found = np.nonzero(names >= 0)
                        yield pd.DataFrame({"query_id": ids[found[0]], "vec_id": names[found], "score": best[found]})

    where = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
    trees = rows.withColumn("shard", where).groupBy("dims", "shard").applyInPandas(plant, "dims int, shard int, tree binary")
    trees = trees.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("dims", "shard", "copy", "tree", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"))
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = sent.select("dims", "shard", F.pmod(F.xxhash64("vec_id"), F.lit(copies)).cast("int").alias("copy"), F.lit(None).cast("binary").alias("tree"), "vec_id", "embedding")
    # In each group the tree comes first (its id is null), then the queries.
    routed = trees.unionByName(sent).repartition("dims", "shard", "copy").sortWithinPartitions("dims", "shard", "copy", "vec_id")
    met = routed.mapInPandas(hunt, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
