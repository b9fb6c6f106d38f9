"""Retrieval queries over embedded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.vector import dot, top_k
from tempora.sources.tables import FRAMES_SQL, frames


def retrieve_topk_per_video(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """Each video's question vector against its frames: the ``k`` most similar, in time order."""
    f = frames(spark, sf_dir)
    ask = f.where("frame_index = 0").select("video_id", F.col("embedding").alias("query"))
    scored = f.join(ask, "video_id").select("video_id", "frame_index", "ts", dot(F.col("embedding"), F.col("query")).alias("score"))
    best = top_k(scored, k, ["video_id"], "score", "frame_index")
    return best.select("video_id", "frame_index", "ts", F.round("score", 6).alias("score"), "rank").orderBy("video_id", "ts")


QUERIES = {"retrieve_topk_per_video": retrieve_topk_per_video}
ORACLE = {
    "retrieve_topk_per_video": f"""
WITH {FRAMES_SQL}, s AS (
  SELECT f.video_id, f.frame_index, f.ts, list_inner_product(f.e, q.e) AS score
  FROM frames f JOIN frames q ON q.video_id = f.video_id AND q.frame_index = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) AS rank FROM s)
SELECT video_id, frame_index, CAST(ts AS DOUBLE) AS ts, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8
"""
}
