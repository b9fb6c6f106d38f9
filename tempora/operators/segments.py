"""Segmentation of ordered frames: folds over ordered rows, and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def cut_when(rows: DataFrame, wanted: str, least: int, most: int, group: str = "video_id", index: str = "frame_index") -> DataFrame:
    """``group, index, segment``: a cut comes before a row if the segment has ``most`` members, or ``least`` and the row is ``wanted``.

    The rows of a group pass once, in order; the state is the segment's number and length.
    """
    kinds = dict(rows.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, length, segment = None, 0, 0
        for batch in batches:
            out = []
            for key, want in zip(batch[group].tolist(), batch["_wanted"].tolist(), strict=True):
                if key != now:
                    now, length, segment = key, 0, 0
                if length >= most or (length >= least and want):
                    length, segment = 0, segment + 1
                length += 1
                out.append(segment)
            yield pd.DataFrame({group: batch[group], index: batch[index], "segment": out})

    slim = rows.select(group, index, F.coalesce(F.col(wanted), F.lit(False)).alias("_wanted"))
    return slim.repartition(group).sortWithinPartitions(group, index).mapInPandas(fold, f"{group} {kinds[group]}, {index} {kinds[index]}, segment long")


def greedy_gap(times: Column, least_gap: float, most: int) -> Column:
    """Of times in order of preference, those at least ``least_gap`` from all taken before; at most ``most``."""
    none = F.array().cast("array<double>")
    return F.aggregate(times, none, lambda kept, t: F.when((F.size(kept) < most) & ~F.exists(kept, lambda x: F.abs(x - t) < least_gap), F.concat(kept, F.array(t))).otherwise(kept))


def gap_clusters(rows: DataFrame, gap: float, group: str = "video_id", t: str = "t", tie: str = "frame_index") -> DataFrame:
    """Rows with the number of their cluster; a new one begins after more than ``gap``."""
    order = Window.partitionBy(group).orderBy(t, tie)
    fresh = F.when(F.col(t) - F.lag(t).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("_f", fresh).withColumn("cluster", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def tumbling_clips(rows: DataFrame, width: float, eps: float = 1e-6, t: str = "t") -> DataFrame:
    """Rows with their clip; one on a boundary belongs to both."""
    clip = F.floor(F.col(t) / width).cast("long")
    on_edge = (F.col(t) - clip * F.lit(width) <= eps) & (clip > 0)
    return rows.withColumn("clip", F.explode(F.when(on_edge, F.array(clip - 1, clip)).otherwise(F.array(clip))))


def best_window(rows: DataFrame, width: Column, value: str, group: str = "video_id", index: str = "frame_index", n: str = "n") -> DataFrame:
    """Start of the window of ``width`` frames with the largest sum, the earliest of equals (``start, width, total``)."""
    upto = Window.partitionBy(group).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("_w", width).withColumn("_s", F.sum(value).over(upto))
    ends = sums.select(F.col(group), (F.col(index) - F.col("_w") + 1).alias("start"), F.col("_w").alias("width"), F.col("_s").alias("_end")).where("start >= 0")
    before = sums.select(F.col(group), (F.col(index) + 1).alias("start"), F.col("_s").alias("_before"))
    scored = ends.join(before, [group, "start"], "left").withColumn("total", F.round(F.col("_end") - F.coalesce("_before", F.lit(0.0)), 6))
    order = Window.partitionBy(group).orderBy(F.desc("total"), "start")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(group, "start", "width", "total")
