"""Similarity and top-k over vectors held in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, k: int, group: list[str], score: str, tie: str) -> DataFrame:
    """Rows of the ``k`` highest scores in each group, ties to the smaller ``tie``, with ``rank``."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
