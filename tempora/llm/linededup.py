"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

1. Every line is keyed and hashed to 128 bits where it lies. The hashes (not
   the lines) are aggregated: in how many documents, and the largest
   ``doc_id`` that holds it. Hashes of a single document never matter and go.
2. The distinct hashes are dealt to shards by their value. Each shard becomes
   one row of compact arrays: a minimal perfect hash (levels of bit arrays
   with ranks), and by its index a fingerprint, the count and the holder.
3. Documents probe the arrays: a probe is the 16 bytes of a line's hash and
   its ``doc_id``, routed to the shard; what comes back are the hashes that
   a document must drop. Lines are neither joined nor moved.

A hash in a third of all documents has as many probes, so a shard's arrays are
copied as often as the documents of its lines ask for (the counts are known),
and the probes spread over the copies. A task holds one shard's arrays and one
batch of probes, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import durable

BLANK = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SECOND_SEED = 77
BROADCAST_ROWS = 1_000_000  # of the small table of copies (12 bytes each)
PROBES = 1 << 16  # of a shard, that stream past one copy of its arrays
SHARD_KEYS = 1 << 17
NO_DOC = -(1 << 63)  # stands for a null doc_id in the arrays
LEVEL_BITS = 2  # bits a key in each level of the hash


# -- the minimal perfect hash --------------------------------------------------


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps ``n`` distinct 64-bit keys to 0..n-1; other keys to anything or -1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels  # one byte of bits for 8 places
        bits = [np.unpackbits(x) for x in levels]
        self.sizes = [len(x) for x in bits]
        ranks = np.cumsum(np.concatenate([*bits, np.zeros(1, np.uint8)]), dtype=np.int64)
        self.bits, self.ranks = np.concatenate([*bits, np.zeros(1, np.uint8)]), ranks
        self.firsts = np.cumsum([0, *self.sizes])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            size = max(64, -(-len(left) * LEVEL_BITS // 64) * 64)
            at = (_spread(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, (size, first) in enumerate(zip(self.sizes, self.firsts, strict=False)):
            if not len(left):
                break
            at = first + (_spread(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            out[left[hit]] = self.ranks[at[hit]] - 1
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        lengths = np.frombuffer(data, "<i8", n, 8)
        ends = 8 * (n + 1) + np.cumsum(lengths)
        return cls([np.frombuffer(data, np.uint8, int(k), int(e - k)) for k, e in zip(lengths, ends, strict=True)])


# -- lines and their hashes ----------------------------------------------------


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line: its key's two hashes, or null if the key is short.

    The key has ASCII letters lowered and ASCII white space stripped; both are
    done on characters, so lines stay lines.
    """
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)

    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANK))
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SECOND_SEED), key).alias("h2")))

    return F.transform(F.split(lowered, "\n", -1), hashed)


def line_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, n_docs, last_doc`` of the line hashes found in two rows or more."""
    seen = docs.select("doc_id", F.explode(F.array_distinct(F.filter(line_hashes(F.col("text"), min_chars), lambda x: x.isNotNull()))).alias("h"))
    return seen.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")).where("n_docs >= 2")


def shard_of(h1: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h1, 8), F.lit(shards)).cast("int")


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """``shard, hash, fingerprints, n_docs, last_doc``: one row of arrays for each shard."""

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (batch[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        # Two keys with one h1 differ in h2, which then takes part in the hash.
        keys = h1 ^ _spread(h2, 63)
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.index(keys))
        last = batch["last_doc"].to_numpy(np.int64)
        return pd.DataFrame(
            {
                "shard": [batch["shard"].iloc[0]],
                "hash": [mph.dump()],
                "fingerprints": [keys[order].astype("<u8").tobytes() + h2[order].astype("<u8").tobytes()],
                "n_docs": [batch["n_docs"].to_numpy(np.int64)[order].astype("<i8").tobytes()],
                "last_doc": [last[order].astype("<i8").tobytes()],
            }
        )

    return counts.withColumn("last_doc", F.coalesce("last_doc", F.lit(NO_DOC).cast("long"))).withColumn("shard", shard_of(F.col("h1"), shards)).groupBy("shard").applyInPandas(build, "shard int, hash binary, fingerprints binary, n_docs binary, last_doc binary")


def copies_of(counts: DataFrame, shards: int, probes: int = PROBES) -> DataFrame:
    """``shard, salts``: copies of the arrays of every shard whose lines have more than ``probes`` holders."""
    load = counts.groupBy(shard_of(F.col("h1"), shards).alias("shard")).agg(F.sum("n_docs").alias("load"))
    return load.where(F.col("load") > probes).select("shard", F.ceil(F.col("load") / probes).cast("int").alias("salts"))


def probe(index: DataFrame, probes: DataFrame, copies: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """``doc_id, h1, h2`` of the probes whose line is in ``min_docs`` documents and kept by another."""
    if copies.count() <= BROADCAST_ROWS:  # else Spark joins them by shuffle
        copies = F.broadcast(copies)
    zero, none, no_doc = F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(NO_DOC).cast("long")
    salts = F.coalesce("salts", F.lit(1))
    arrays = index.join(copies, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("shard", "salt", F.lit(0).alias("kind"), zero.alias("doc_id"), zero.alias("h1"), zero.alias("h2"), "hash", "fingerprints", "n_docs", "last_doc")
    asked = probes.withColumn("shard", shard_of(F.col("h1"), shards)).join(copies, "shard", "left")
    asked = asked.select("shard", F.pmod(F.xxhash64("doc_id", "h1"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.coalesce(F.col("doc_id").cast("long"), no_doc).alias("doc_id"), "h1", "h2", none.alias("hash"), none.alias("fingerprints"), none.alias("n_docs"), none.alias("last_doc"))
    routed = asked.unionByName(arrays).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            starts = np.flatnonzero(kinds == 0)
            shard, salt = batch["shard"].to_numpy(), batch["salt"].to_numpy()
            cuts = np.unique(np.concatenate([[0], starts, np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(batch)]]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if kinds[lo] == 0:
                    row = batch.iloc[lo]
                    n = len(row["n_docs"]) // 8
                    prints = np.frombuffer(row["fingerprints"], "<u8")
                    held = (shard[lo], salt[lo]), PerfectHash.load(row["hash"]), prints[:n], prints[n:], np.frombuffer(row["n_docs"], "<i8"), np.frombuffer(row["last_doc"], "<i8")
                    lo += 1
                if lo == hi or held is None or held[0] != (shard[lo], salt[lo]):
                    continue  # no line of this shard is in two documents
                _, mph, first, second, n_docs, last = held
                part = batch.iloc[lo:hi]
                h1, h2 = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
                keys = h1 ^ _spread(h2, 63)
                at = mph.index(keys)
                ids = part["doc_id"].to_numpy(np.int64)
                safe = np.maximum(at, 0)
                drop = (at >= 0) & (first[safe] == keys) & (second[safe] == h2) & (n_docs[safe] >= min_docs) & (last[safe] != ids)
                if drop.any():
                    yield part.loc[drop, ["doc_id", "h1", "h2"]]

    return routed.mapInPandas(run, "doc_id long, h1 long, h2 long").withColumn("doc_id", F.nullif("doc_id", no_doc))


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """All columns of ``docs``, with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and is found in
    ``min_docs`` rows or more (``min_docs`` of 2 at least) is dropped, except
    from the rows with the largest ``doc_id`` that holds it. A null or empty
    text is one empty line. A null ``doc_id`` is smaller than any other. Rows
    that repeat count each; those with one ``doc_id`` keep and drop together. Very
    long texts are read whole; an empty table gives no rows.
    Columns named like the results are replaced.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    counts = durable(line_counts(docs, min_chars))
    shards = max(1, -(-counts.count() // shard_keys))
    probes = docs.select("doc_id", F.explode(F.array_distinct(F.filter(line_hashes(F.col("text"), min_chars), lambda x: x.isNotNull()))).alias("h")).select("doc_id", "h.h1", "h.h2")
    hits = probe(build_index(counts, shards), probes, durable(copies_of(counts, shards)), shards, min_docs)
    drops = hits.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))

    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    told = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("_lines", lines)
    pairs = F.arrays_zip(F.col("_lines").alias("line"), line_hashes(F.col("text"), min_chars).alias("hash"))
    kept = F.transform(F.filter(pairs, lambda x: x["hash"].isNull() | ~F.array_contains(F.col("_drops"), x["hash"])), lambda x: x["line"])
    told = told.withColumn("_kept", F.when(F.col("_drops").isNull(), F.col("_lines")).otherwise(kept))
    return told.select(
        *docs.columns,
        F.when(F.col("_drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("_kept", "\n")).alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )
