"""Sampling of ordered frames: indexes are generated by expression and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform_indexes(n: Column, k: Column) -> Column:
    """Distinct ``floor(i * n / k)`` for i < k, with k within 1 and n; none for n = 0."""
    kk = F.greatest(F.lit(1), F.least(k, n)).cast("long")
    at = F.transform(F.sequence(F.lit(0).cast("long"), kk - 1), lambda i: F.floor(i.cast("double") * (n.cast("double") / kk.cast("double"))).cast("long"))
    return F.when(n > 0, F.array_distinct(at)).otherwise(F.array().cast("array<bigint>"))


def range_indexes(n: Column, fps: Column, t0: Column, t1: Column, k: Column) -> Column:
    """Indexes spread over a time range, both ends taken; the first one alone for k = 1."""
    low = F.greatest(F.lit(0), F.least(F.bround(t0 * fps, 0).cast("long"), n - 1))
    high = F.greatest(low, F.least(F.bround(t1 * fps, 0).cast("long"), n - 1))
    kk = F.greatest(F.lit(1), F.least(k, high - low + 1)).cast("long")
    spread = F.transform(F.sequence(F.lit(0).cast("long"), kk - 1), lambda i: F.bround(low + i.cast("double") * (high - low) / (kk - 1), 0).cast("long"))
    return F.when(kk == 1, F.array(low)).otherwise(F.array_distinct(spread))


def ingest_target(duration: Column, n: Column, cap: Column, rate: float = 2.0) -> Column:
    """Frames to ingest: the rate times the duration (all frames, if it is unknown), within 1 and the cap."""
    target = F.when(duration > 0, F.bround(duration * rate, 0).cast("long")).otherwise(n)
    return F.greatest(F.lit(1).cast("long"), F.least(target, cap.cast("long")))


def take(frames: DataFrame, indexes: Column, video: str = "video_id", index: str = "frame_index") -> DataFrame:
    """Frames whose index is in the array that ``indexes`` gives for their video."""
    return frames.where(F.array_contains(indexes, F.col(index)))


def stride(frames: DataFrame, k: int, video: str = "video_id", index: str = "frame_index", n: str = "n") -> DataFrame:
    """Every ``max(1, n // k)``-th frame, at most ``k``."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col(n) / k).cast("long"))
    return frames.where((F.col(index) % step == 0) & (F.floor(F.col(index) / step) < k))


def chunked(rows: DataFrame, size: int, group: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of the fixed-size group they fall into."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.withColumn("chunk", F.floor(at / size).cast("long"))


def linspace_indexes(n: Column, room: Column) -> Column:
    """All of ``n`` indexes if they fit, else ``room`` spread evenly with both ends, halves rounded to even, none twice."""
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1)
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(room, F.lit(1)).cast("long") - 1), lambda i: F.bround(i.cast("double") * (n - 1) / F.greatest(room - 1, F.lit(1)), 0).cast("long"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= room, every).otherwise(F.array_distinct(at))


def hard_cap(requests: DataFrame, cap: int, frames: str = "frames") -> DataFrame:
    """The requests as they are; one that shows more than ``cap`` frames fails the query."""
    over = F.concat(F.lit("a request shows "), F.col(frames).cast("string"), F.lit(f" frames, {cap} at most"))
    return requests.withColumn(frames, F.when(F.col(frames) <= cap, F.col(frames)).otherwise(F.raise_error(over).cast(dict(requests.dtypes)[frames])))


def pinned(manifest: DataFrame, pool: DataFrame, key: str, order: str) -> DataFrame:
    """The pool's rows of a manifest, in its order; an id that the pool lacks fails the query."""
    missing = F.concat(F.lit("not in the pool: "), F.col(key).cast("string"))
    there = pool.withColumn("_there", F.lit(True))
    joined = manifest.join(there, key, "left").withColumn(key, F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(missing).cast(dict(manifest.dtypes)[key])))
    return joined.drop("_there").orderBy(order)
