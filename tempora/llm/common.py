"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read through Spark (any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    The folder comes from the session. A folder of our own is set only where
    the session names none and all executors are in this process, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tempora-checkpoint-"))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that checkpoints have made needless.

    Spark drops them when the driver collects the plans that wrote them, which
    may be long after if the driver has memory to spare.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unit_uniform(*cols: Column) -> Column:
    """A number in [0, 1) with 53 random bits that depends on ``cols`` only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def text_bytes(df: DataFrame, column: str = "text") -> Column:
    """UTF-8 length of the text; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
