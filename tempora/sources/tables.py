"""The bundled tables, and the views of them that the engine's model needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIDEO_FRAMES = 1000  # ids of a video, so that a video's length does not grow with the table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_id, frame_index, ts, vec_id, embedding``: one video for each label (below 1000) and thousand ids, two frames a second."""
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    video = (F.col("label") + 1000 * F.floor(F.col("vec_id") / VIDEO_FRAMES)).cast("long")
    e = e.select(video.alias("video_id"), "vec_id", "embedding")
    at = (F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1).cast("long")
    return e.select("video_id", at.alias("frame_index"), "vec_id", "embedding").withColumn("ts", F.col("frame_index") / 2.0)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_id, frame_index, t, n, value, event_id, event_type``: one video for each user of ``events``.

    ``t`` is in units of 1000 s since the user's first event, so a month is some 2,600.
    """
    e = table(spark, sf_dir, "events")
    video = Window.partitionBy("user_id")
    order = video.orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        ((us - F.min(us).over(video)) / F.lit(1e9)).alias("t"),
        F.count(F.lit(1)).over(video).alias("n"),
        "value",
        "event_id",
        "event_type",
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_id, frame_index, role, caption``: conversations as captioned frames."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("frame_index"), "role", F.col("text").alias("caption"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qidx, source, lang, ref_ok, cand_ok``: labelled documents as paired outcomes of two systems."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    joined = labels.join(docs.select("doc_id", "source", "lang"), "doc_id")
    return joined.select(F.col("doc_id").alias("qidx"), "source", "lang", (F.col("quality") == 1).alias("ref_ok"), (F.col("toxic") == 0).alias("cand_ok"))


#: The same views as common table expressions of the oracle.
FRAMES_SQL = "fv AS (SELECT CAST(label + 1000 * (vec_id // 1000) AS BIGINT) AS video_id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL), frames AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1 AS frame_index, vec_id, e, (row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1) / 2.0 AS ts FROM fv)"
TIMELINE_SQL = "tl AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e9 AS t, count(*) OVER (PARTITION BY user_id) AS n, value, event_id, event_type FROM events)"
JUDGED_SQL = "judged AS (SELECT l.doc_id AS qidx, d.source, d.lang, l.quality = 1 AS ref_ok, l.toxic = 0 AS cand_ok FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
