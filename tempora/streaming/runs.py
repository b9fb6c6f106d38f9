"""Streams that run over what is there and leave their final state as a table."""

from __future__ import annotations

import tempfile
import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors share: in ``spark.checkpoint.dir``, or a local one where all executors are in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="tempora-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The files of a table (one file, or a folder of them) as a stream, times without a zone taken as the session's."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = name.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(name).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def final_state(stream: DataFrame, mode: str = "append", trailing: DataFrame | None = None) -> DataFrame:
    """Run a stream to the end of its input and return what it put out.

    In append mode a window leaves the state when the watermark has passed it;
    ``trailing`` is what the last windows, still open at the end, come to.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    out = f"{folder}/state"
    spark.createDataFrame([], stream.schema).write.parquet(out)  # an empty input leaves an empty table

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.schema(stream.schema).parquet(out)
    return closed if trailing is None else closed.unionByName(trailing)


def online(rows: DataFrame, batch: str, key: str, value: str) -> DataFrame:
    """Rows with ``predicted`` by a loop over batches that keeps a state table between them.

    Each batch is predicted with the state that the batches before have left
    (``key, total, n``), then learned: the state is written anew, one version a
    batch, so a run that breaks off goes on from the last version.
    """
    spark = rows.sparkSession
    folder = work_folder(spark)
    state = spark.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, total double, n long")
    state.write.parquet(f"{folder}/state-0")
    batches = [r[0] for r in rows.select(batch).distinct().orderBy(batch).collect()]
    for version, b in enumerate(batches):
        now = rows.where(F.col(batch) == F.lit(b))
        state = load_state(spark, folder, version)
        told = now.join(state, key, "left").withColumn("predicted", F.col("total") / F.col("n")).select(*rows.columns, "predicted")
        told.write.mode("append").parquet(f"{folder}/told")
        learned = now.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
        state.unionByName(learned).groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).write.parquet(f"{folder}/state-{version + 1}")
    if not batches:
        return rows.withColumn("predicted", F.lit(None).cast("double"))
    return spark.read.parquet(f"{folder}/told")


def load_state(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The state table as a batch has left it."""
    return spark.read.parquet(f"{folder}/state-{version}")


def prequential(rows: DataFrame, batch: str, key: str, value: str) -> DataFrame:
    """Rows with ``predicted``: the mean of the key's values in earlier batches.

    What a batch teaches is seen from the next batch on, never within it.
    """
    before = Window.partitionBy(key).orderBy(batch).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("predicted", F.avg(value).over(before))


def epochs(batches: list[DataFrame], judge: DataFrame, key: str, value: str, patience: int = 2) -> DataFrame:
    """``epoch, error, best, stopped``: learn a batch an epoch, judge after each, stop after ``patience`` epochs without a smaller error.

    The state (``key, total, n``) is a table between epochs; ``best`` marks the epoch whose state is restored.
    """
    spark = judge.sparkSession
    folder = work_folder(spark)
    state = spark.createDataFrame([], f"{key} {dict(judge.dtypes)[key]}, total double, n long")
    told: list[tuple[int, float]] = []
    for epoch, batch in enumerate(batches, 1):
        learned = batch.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
        state.unionByName(learned).groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).write.parquet(f"{folder}/state-{epoch}")
        state = load_state(spark, folder, epoch)
        missed = judge.join(state, key, "left").select(F.avg(F.abs(F.col(value) - F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)))))
        told.append((epoch, round(missed.first()[0] or 0.0, 6)))
        best = min(told, key=lambda x: (x[1], x[0]))[0]
        if epoch - best >= patience:
            break
    return spark.createDataFrame([(e, x, e == best, len(told) < len(batches)) for e, x in told], "epoch int, error double, best boolean, stopped boolean")
