"""Interval algebra: union, containment and distance, by video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(intervals: DataFrame, group: str = "video_id") -> DataFrame:
    """Union of intervals ``lo, hi`` in each group; touching ones merge."""
    before = Window.partitionBy(group).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    marked = intervals.withColumn("_new", F.when(F.max("hi").over(before) >= F.col("lo"), 0).otherwise(1))
    upto = Window.partitionBy(group).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("island", F.sum("_new").over(upto))
    return numbered.groupBy(group, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def gap(t: Column, lo: Column, hi: Column) -> Column:
    """Distance of a time from a closed interval; zero inside."""
    return F.greatest(F.lit(0.0), lo - t, t - hi)


def inside(points: DataFrame, intervals: DataFrame, how: str, group: str = "video_id", t: str = "t") -> DataFrame:
    """Points that lie in any interval of their group (``left_semi``) or in none (``left_anti``), ends included.

    Starts and points are put in one order; a point is inside if an interval
    that began by then has not ended. So the work is a sort, not a product.
    """
    starts = intervals.select(F.col(group), F.col("lo").alias(t), F.lit(0).alias("_kind"), F.col("hi").alias("_hi"))
    both = points.withColumn("_kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    upto = Window.partitionBy(group).orderBy(t, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    within = F.coalesce(F.max("_hi").over(upto) >= F.col(t), F.lit(False))
    return both.withColumn("_in", within).where(F.col("_kind") == 1).where(F.col("_in") == (how == "left_semi")).select(*points.columns)
