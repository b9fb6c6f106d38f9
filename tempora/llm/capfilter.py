"""Embedding near-dedup by spherical-cap filters.

A filter is a direction of a structured random product code: one unit vector
for each half of the coordinates, so ``codes`` vectors a half make ``codes``
squared directions. Each vector is list-decoded to all directions whose cap
holds it: half scores are sorted, and only sums that can exceed the threshold
are formed. Vectors of one label that share a filter are compared, in double
precision; a pair that shares several is taken at the smallest one.

Equal vectors are one node from the start. Links are counted and joined into a
spanning forest inside a cell, so pairs are never put out. A cell with very
many different vectors is cut into chunks, and its pairs of chunks are cells
of their own, in other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import durable
from tempora.llm.components import components, local_forest
from tempora.llm.vptree import usable

CAP = 3.7  # threshold in deviations of a random direction's score
LISTED = 64  # filters that a random vector exceeds, on average
CHUNK = 2048
SMALL = 24  # cells up to this size are compared many at once

LISTS = "label int, vec_id long, copies long, embedding array<double>, dims int, filters array<int>"


@lru_cache(maxsize=8)
def product_code(dims: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit vectors for either half, and the score that a filter's members reach."""
    rng = np.random.default_rng([seed, dims])

    def unit(n: int, d: int) -> np.ndarray:
        x = rng.standard_normal((n, max(1, d)))
        return (x / np.linalg.norm(x, axis=1, keepdims=True))[:, :d] if d else np.zeros((n, 0))

    least = min(CAP / np.sqrt(dims), 0.55)
    half = dims // 2
    x = unit(400, dims)
    scores = (x[:, :half] @ unit(1000, half).T)[:, :, None] + (x[:, half:] @ unit(1000, dims - half).T)[:, None, :100]
    share = max(float((scores / np.sqrt(2) >= least).mean()), 1e-7)
    codes = int(np.clip(np.ceil(np.sqrt(LISTED / share)), 2, 4096))
    return unit(codes, half), unit(codes, dims - half), least * np.sqrt(2)


def list_decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and filter of all filters that the unit vectors ``x`` exceed, filters ascending in a row."""
    first, second, least = product_code(x.shape[1])
    half = x.shape[1] // 2
    a, b = x[:, :half] @ first.T, x[:, half:] @ second.T
    row, i = np.nonzero(a >= least - b.max(axis=1, keepdims=True))
    rows, filters = [], []
    for at in range(0, len(row), 8192):
        r, c = row[at : at + 8192], i[at : at + 8192]
        k, j = np.nonzero(b[r] >= (least - a[r, c])[:, None])
        rows.append(r[k])
        filters.append(c[k].astype(np.int64) * len(second) + j)
    return (np.concatenate(rows), np.concatenate(filters)) if rows else (row, i)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


#: What a cell's rows have in common: the filter, and the chunks it is cut into.
CELL = ["label", "dims", "filter", "i", "j"]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lengths = batch["embedding"].map(len).to_numpy()
        for dims in np.unique(lengths):
            same = batch[lengths == dims]
            for start in range(0, len(same), 1024):
                part = same.iloc[start : start + 1024]
                row, found = list_decode(_unit(np.stack(part["embedding"]).astype(np.float64)))
                order = np.lexsort((found, row))
                own = np.split(found[order].astype(np.int32), np.searchsorted(row[order], np.arange(1, len(part))))
                yield part.assign(dims=int(dims), filters=own)[[c.split()[0] for c in LISTS.split(", ")]]


def _first_shared(at: np.ndarray, filters: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows: whether no filter below the row's cell is shared."""
    if len(a) <= 4 * len(filters):
        return np.array([np.intersect1d(filters[i], filters[j], assume_unique=True)[0] == at[i] for i, j in zip(a, b, strict=True)], bool)
    below = [f[f < x] for f, x in zip(filters, at, strict=True)]
    names, flat = np.unique(np.concatenate(below), return_inverse=True)
    held = np.zeros((len(filters), len(names)), np.float32)
    held[np.repeat(np.arange(len(below)), [len(f) for f in below]), flat] = 1
    out = np.empty(len(a), bool)
    for s in range(0, len(a), 65536):
        out[s : s + 65536] = np.einsum("ij,ij->i", held[a[s : s + 65536]], held[b[s : s + 65536]]) == 0
    return out


def _compare(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def told(a: np.ndarray, b: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> Iterator[pd.DataFrame]:
            if not len(a):
                return
            who, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            n = np.bincount(at, np.concatenate([copies[b], copies[a]])).astype(np.int64)
            node, root = local_forest(ids[a], ids[b])
            yield pd.DataFrame({"a": np.concatenate([ids[who], node]), "b": np.concatenate([ids[who], root]), "n": np.concatenate([n, np.zeros(len(node), np.int64)])})

        def cells(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            key = part[CELL].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]])
            ids, copies, at = part["vec_id"].to_numpy(), part["copies"].to_numpy(), part["filter"].to_numpy()
            split, chunk, i = (part["i"] != part["j"]).to_numpy(), part["chunk"].to_numpy(), part["i"].to_numpy()
            filters = part["filters"].to_numpy()
            sizes = ends - starts
            left, right = [], []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
                x, y = np.triu_indices(size, 1)
                first = starts[(sizes == size)]
                left.append((first[:, None] + x).ravel())
                right.append((first[:, None] + y).ravel())
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                apart = ~split[a] | (chunk[a] != chunk[b])
                a, b = a[apart], b[apart]
                rows, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
                vectors, dims = part["embedding"].to_numpy()[rows], part["dims"].to_numpy()[rows]
                near = np.zeros(len(a), bool)
                fa, fb = flat[: len(a)], flat[len(a) :]
                for d in np.unique(dims):  # a cell's vectors have one length, a batch's may not
                    unit = np.zeros((len(rows), d))
                    unit[dims == d] = _unit(np.stack(vectors[dims == d]).astype(np.float64))
                    for s in range(0, len(a), 65536):
                        f, g = fa[s : s + 65536], fb[s : s + 65536]
                        near[s : s + 65536] |= (dims[f] == d) & (np.einsum("ij,ij->i", unit[f], unit[g]) >= least)
                a, b = a[near], b[near]
                if len(a):
                    keep = np.array([np.intersect1d(filters[p], filters[q], assume_unique=True)[0] == at[p] for p, q in zip(a, b, strict=True)], bool)
                    yield from told(a[keep], b[keep], ids, copies)
            for lo, hi in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
                unit = _unit(np.stack(part["embedding"].to_numpy()[lo:hi]).astype(np.float64))
                own = list(filters[lo:hi])
                ids_, copies_, at_ = ids[lo:hi], copies[lo:hi], at[lo:hi]
                side = chunk[lo:hi] == i[lo:hi]
                for s in range(0, hi - lo, 512):
                    a, b = np.nonzero(unit[s : s + 512] @ unit.T >= least)
                    a += s
                    ok = (side[a] & ~side[b]) if split[lo] else a < b
                    a, b = a[ok], b[ok]
                    keep = _first_shared(at_, own, a, b) if len(a) else np.zeros(0, bool)
                    yield from told(a[keep], b[keep], ids_, copies_)

        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held[CELL].iloc[-1]
            whole = int((held[CELL] != last).any(axis=1).sum())
            if whole:
                yield from cells(held.iloc[:whole].reset_index(drop=True))
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None:
            yield from cells(held)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row (``vec_id, embedding, label``).

    Rows link if their labels are equal and not null, and the cosine is ``least``
    or more. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do rows with a null id. Rows that repeat
    link with each other; their count is of rows. A cosine of exactly ``least``
    links. An empty table gives no rows; other columns, clashing or not, are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    able = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    able = able.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h"))
    nodes = durable(able.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("h").alias("h")))

    lists = durable(nodes.select("label", "vec_id", "copies", "embedding").mapInPandas(_decode, LISTS))
    listed = lists.select("label", "dims", F.explode("filters").alias("filter"), "vec_id")
    sizes = listed.groupBy("label", "dims", "filter").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = listed.join(sizes, ["label", "dims", "filter"]).withColumn("chunks", F.ceil(F.col("members") / chunk).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("label", "dims", "filter", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "vec_id")
    dealt = dealt.join(lists.select("label", "vec_id", "copies", "embedding", "filters"), ["label", "vec_id"])
    found = durable(dealt.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(_compare(least), "a long, b long, n long"))

    linked = found.groupBy("a").agg(F.sum("n").alias("n")).where("n > 0")
    roots = components(found.select("a", "b"))
    told = nodes.join(linked, nodes.vec_id == linked.a, "left").join(roots, nodes.vec_id == roots.node, "left")
    told = told.select("label", "h", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    joined = rows.withColumn("h", F.xxhash64("embedding")).join(told.withColumnRenamed("embedding", "same"), ["label", "h"], "left").where(F.col("same").isNull() | (F.col("same") == F.col("embedding")))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))
