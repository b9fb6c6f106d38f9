"""Joins, set operations and record parsing that evaluation runs need around selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions import text as tx
from tempora.functions.models import request_key
from tempora.sources.tables import captions, table, timeline

#: Markers of source text that a text-only program must not hold (fixed values).
FORBIDDEN = ("render_frames(", "embed_images(", '"type": "image"', "'type': 'image'")


def seeded_shuffle(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """Positions of all documents in an order that a seed and the id decide."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws(":", F.lit(seed), "doc_id")).alias("key"))
    # Positions within a bucket of the key, and buckets before it: no task orders all rows.
    d = d.withColumn("bucket", F.left("key", F.lit(2)))
    sizes = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("bucket", before.alias("first"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "doc_id"))
    return d.withColumn("_r", within).join(F.broadcast(firsts), "bucket").select("doc_id", (F.col("first") + F.col("_r")).alias("position"))


def resize_dims(spark: SparkSession, sf_dir: str, side: int = 224) -> DataFrame:
    """Sizes scaled so that the long side is at most 224, whole numbers, one at least."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 16).alias("w"), (F.col("p_size") * 9 + 1).alias("h"))
    long = F.greatest("w", "h")
    fit = lambda c: F.when(long > side, F.greatest(F.lit(1), F.floor(F.col(c) * side / long))).otherwise(F.col(c)).cast("long")
    return p.select("p_partkey", fit("w").alias("width"), fit("h").alias("height"))


def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent source of each language, the first by name of equals."""
    g = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "source")
    return g.withColumn("r", F.row_number().over(order)).where("r = 1").select("lang", "source", "n")


def positional_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their truth by id, and by position in their source where the id is unknown."""
    order = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(order).alias("pos"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("by_id"))
    place = F.concat(F.lit("src"), F.col("doc_id") % 20)
    spot = table(spark, sf_dir, "labels").select(place.alias("source"), "doc_id", F.col("quality").alias("by_pos"))
    spot = spot.withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).drop("doc_id")
    return d.join(labels, "doc_id", "left").join(spot, ["source", "pos"], "left").select("doc_id", F.coalesce("by_id", "by_pos").alias("truth"), F.col("by_id").isNotNull().alias("by_id"))


def context_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of prompt beyond the question, by conversation."""
    c = captions(spark, sf_dir)
    g = c.groupBy("video_id").agg(F.sum(F.length("caption")).alias("prompt"), F.sum(F.when(F.col("frame_index") == 0, F.length("caption")).otherwise(0)).alias("question"))
    return g.select("video_id", F.greatest(F.lit(0).cast("long"), F.col("prompt") - F.col("question")).alias("context"))


def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three turns of each conversation, shortened, and how many more there are."""
    c = captions(spark, sf_dir)
    g = c.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", F.left("caption", F.lit(20)).alias("s")))).alias("x"))
    head = F.array_join(F.transform(F.slice("x", 1, 3), lambda y: y["s"]), " → ")
    more = F.size("x") - 3
    return g.select("video_id", F.md5(F.concat(head, F.when(more > 0, F.concat(F.lit(" (+ "), more, F.lit(" more moments)"))).otherwise(""))).alias("summary_md5"))


def policy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs (here pages, some with a call put in) whose source holds a marker that a text-only one must not, and which."""
    d = table(spark, sf_dir, "pages")
    put = F.element_at(F.array(F.lit(""), F.lit("self.render_frames(x)"), F.lit('{"type": "image"}'), F.lit("{'type': 'text'}"), F.lit("render_frames = 1")), (F.col("page_id") % 5 + 1).cast("int"))
    source = F.concat(F.col("html"), F.lit("\n"), put)
    found = F.filter(F.array(*[F.lit(m) for m in FORBIDDEN]), lambda m: F.contains(source, m))
    return d.select("page_id", F.array_join(found, ", ").alias("violations"), (F.size(found) > 0).alias("rejected"))


def test_system_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems to test: baselines, those on the frontier of score and cost, and the best of each dataset, once each."""
    o = table(spark, sf_dir, "orders")
    base = o.where("o_custkey % 10 = 0").select("o_custkey")
    best = o.groupBy("o_orderpriority").agg(F.max_by("o_custkey", F.struct("o_totalprice", "o_orderkey")).alias("o_custkey")).select("o_custkey")
    # Of equal costs the best score alone can be on the frontier, so the order to scan is one of whole costs.
    s = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("score"), F.count(F.lit(1)).alias("cost"))
    top = s.groupBy("cost").agg(F.max("score").alias("score"))
    before = F.max("score").over(Window.partitionBy(F.lit(1)).orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    front = top.withColumn("_b", before).where("_b IS NULL OR score > _b").select("cost", "score")
    pareto = s.join(F.broadcast(front), ["cost", "score"]).select("o_custkey")
    return base.union(best).union(pareto).distinct().select(F.col("o_custkey").alias("system"))


def concat_then_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits scored in one pass and told apart again."""
    d = table(spark, sf_dir, "labels")
    both = d.where("doc_id % 2 = 0").withColumn("split", F.lit("val")).unionByName(d.where("doc_id % 2 = 1").withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.sum("quality").alias("correct"))


def fresh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates, customers of one nation and number as programs there before: a candidate is fresh if none has as late a state."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    latest = c.groupBy(F.col("c_nationkey").alias("s_nationkey"), (F.col("c_custkey") % 50).alias("number")).agg(F.max("c_acctbal").alias("most"))
    return s.withColumn("number", F.col("s_suppkey") % 50).join(latest, ["s_nationkey", "number"], "left").where("most IS NULL OR most < s_acctbal").select("s_suppkey")


def baseline_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose settings have a result in the shared cache already."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.left(request_key(F.lit("v1"), F.col("s_nationkey")), F.lit(16)).alias("key"))
    cache = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.left(request_key(F.lit("v1"), F.col("n_nationkey")), F.lit(16)).alias("key"), F.lit(True).alias("cached"))
    return s.join(cache, "key", "left").select("s_suppkey", F.coalesce("cached", F.lit(False)).alias("cached"))


def first_batches(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """Captions asked for in batches: what each call would hold."""
    c = timeline(spark, sf_dir).withColumn("call", F.floor(F.col("frame_index") / size).cast("long"))
    return c.groupBy("video_id", "call").agg(F.count(F.lit(1)).alias("captions"), F.round(F.min("t"), 6).alias("from_t"))


def modal_folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the path stated for their id; of several paths the one in the language's most frequent folder, then the first."""
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    paths = labels.select("doc_id", F.explode(F.array((F.col("doc_id") % 3).cast("string"), (F.col("quality") + 3).cast("string"))).alias("folder"))
    paths = d.join(paths, "doc_id").withColumn("path", F.concat_ws("/", "folder", "doc_id"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "folder")
    mode = paths.groupBy("lang", "folder").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(order)).where("r = 1").select("lang", F.col("folder").alias("modal"))
    pick = Window.partitionBy("doc_id").orderBy(F.when(F.col("folder") == F.col("modal"), 0).otherwise(1), "path")
    best = paths.join(mode, "lang").withColumn("r", F.row_number().over(pick)).where("r = 1").select("doc_id", "path")
    return d.select("doc_id").join(best, "doc_id", "left")


QUERIES = {f.__name__: f for f in (seeded_shuffle, resize_dims, modal_value, positional_fallback_join, context_length, event_summaries, policy_check, test_system_set, concat_then_split, fresh_candidates, baseline_cache, first_batches, modal_folder_paths)}
ORACLE = {
    "seeded_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS position FROM documents",
    "resize_dims": "WITH p AS (SELECT p_partkey, p_size * 16 AS w, p_size * 9 + 1 AS h FROM part) SELECT p_partkey, CASE WHEN greatest(w, h) > 224 THEN greatest(1, w * 224 // greatest(w, h)) ELSE w END::BIGINT AS width, CASE WHEN greatest(w, h) > 224 THEN greatest(1, h * 224 // greatest(w, h)) ELSE h END::BIGINT AS height FROM p",
    "modal_value": "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) = 1",
    "positional_fallback_join": "WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents), s AS (SELECT 'src' || doc_id % 20 AS source, quality, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS pos FROM labels) SELECT d.doc_id, coalesce(l.quality, s.quality) AS truth, l.quality IS NOT NULL AS by_id FROM d LEFT JOIN labels l USING (doc_id) LEFT JOIN s ON s.source = d.source AND s.pos = d.pos",
    "context_length": "SELECT conv_id AS video_id, CAST(greatest(0, sum(length(text)) - sum(CASE WHEN turn = 0 THEN length(text) ELSE 0 END)) AS BIGINT) AS context FROM conversations GROUP BY 1",
    "event_summaries": "WITH g AS (SELECT conv_id, list(left(text, 20) ORDER BY turn, left(text, 20)) AS x FROM conversations GROUP BY 1) SELECT conv_id AS video_id, md5(array_to_string(x[1:3], ' → ') || CASE WHEN len(x) > 3 THEN ' (+ ' || (len(x) - 3) || ' more moments)' ELSE '' END) AS summary_md5 FROM g",
    "policy_check": """WITH s AS (SELECT page_id, html || chr(10) || (['', 'self.render_frames(x)', '{"type": "image"}', '{''type'': ''text''}', 'render_frames = 1'])[page_id % 5 + 1] AS src FROM pages),
f AS (SELECT page_id, list_filter(['render_frames(', 'embed_images(', '"type": "image"', '''type'': ''image'''], lambda m: contains(src, m)) AS v FROM s) SELECT page_id, array_to_string(v, ', ') AS violations, len(v) > 0 AS rejected FROM f""",
    "test_system_set": """WITH t AS (SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS s, count(*) AS k FROM orders GROUP BY 1)
SELECT o_custkey AS system FROM orders WHERE o_custkey % 10 = 0 UNION SELECT o_custkey FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1
UNION SELECT c FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.s >= a.s AND b.k <= a.k AND (b.s > a.s OR b.k < a.k))""",
    "concat_then_split": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'test' END AS split, count(*) AS total, CAST(sum(quality) AS BIGINT) AS correct FROM labels GROUP BY 1",
    "fresh_candidates": "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_custkey % 50 = s.s_suppkey % 50 AND c.c_acctbal >= s.s_acctbal)",
    "baseline_cache": "SELECT s_suppkey, coalesce(n_regionkey < 3, false) AS cached FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
    "first_batches": "WITH tl AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e9 AS t FROM events) SELECT video_id, frame_index // 8 AS call, count(*) AS captions, round(min(t), 6) AS from_t FROM tl GROUP BY 1, 2",
    "modal_folder_paths": """WITH p AS (SELECT d.doc_id, d.lang, unnest([(l.doc_id % 3)::VARCHAR, (l.quality + 3)::VARCHAR]) AS folder FROM documents d JOIN labels l USING (doc_id)), m AS (SELECT lang, folder AS modal FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, folder) = 1),
b AS (SELECT doc_id, folder || '/' || doc_id AS path FROM p JOIN m USING (lang) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN folder = modal THEN 0 ELSE 1 END, folder || '/' || doc_id) = 1) SELECT documents.doc_id, path FROM documents LEFT JOIN b USING (doc_id)""",
}
