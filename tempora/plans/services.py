"""Models and embedders called in batches, with stubs that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import models
from tempora.sources.tables import captions


def caption_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions asked for eight at a time; a call that fails is asked again one by one, and what fails alone has none."""
    def model(prompts: list[str]) -> list[str]:
        if any("z" in p for p in prompts):
            raise ValueError("the model is down")
        return [p.upper() for p in prompts]

    c = captions(spark, sf_dir).select("video_id", "frame_index", F.regexp_replace(F.lower(F.left("caption", F.lit(40))), "[^a-z ]", "").alias("prompt"))
    return models.call(c, "prompt", model).select("video_id", "frame_index", "reply")


def cached_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies through a cache: what is in it is not asked again."""
    c = captions(spark, sf_dir).select("video_id", "frame_index", F.concat(F.lit("turn "), F.col("frame_index")).alias("prompt")).withColumn("key", F.md5("prompt"))
    cache = c.where("frame_index % 2 = 0").select("key", F.lit("cached").alias("reply")).distinct()
    replies, _ = models.through_cache(c, cache, "prompt", lambda prompts: [f"fresh {p}" for p in prompts])
    return replies.select("video_id", "frame_index", "reply")


def embed_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of captions from the stub embedder: how many places are filled, and the largest share."""
    c = captions(spark, sf_dir).select("video_id", "frame_index", F.regexp_replace(F.lower("caption"), "[^a-z0-9 ]", " ").alias("text"))
    e = models.embed(c, "text", models.stub_embedder)
    return e.select("video_id", "frame_index", F.size(F.filter("embedding", lambda x: x > 0)).alias("filled"), F.round(F.array_max("embedding"), 6).alias("largest"))


QUERIES = {f.__name__: f for f in (caption_service, cached_service, embed_service)}
ORACLE = {
    "caption_service": "WITH c AS (SELECT conv_id, turn, regexp_replace(lower(left(text, 40)), '[^a-z ]', '', 'g') AS p FROM conversations) SELECT conv_id AS video_id, turn AS frame_index, CASE WHEN NOT contains(p, 'z') THEN upper(p) END AS reply FROM c",
    "cached_service": "SELECT conv_id AS video_id, turn AS frame_index, CASE WHEN turn % 2 = 0 THEN 'cached' ELSE 'fresh turn ' || turn END AS reply FROM conversations",
    "embed_service": """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '[a-z0-9]+')) AS token FROM conversations), n AS (SELECT conv_id, turn, CAST(concat('0x', right(md5(token), 3)) AS INT) % 256 AS slot, count(*) AS n FROM t GROUP BY 1, 2, 3),
s AS (SELECT conv_id, turn, count(*) AS filled, round(max(n) / sqrt(sum(n * n)), 6) AS largest FROM n GROUP BY 1, 2) SELECT c.conv_id AS video_id, c.turn AS frame_index, CAST(coalesce(filled, 0) AS INT) AS filled, coalesce(largest, 0.0)::DOUBLE AS largest FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn""",
}
