"""Segmentation and sequence analytics over timelines and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.operators import segments
from tempora.operators.vector import dot
from tempora.sources.tables import FRAMES_SQL, TIMELINE_SQL, captions, frames, timeline


def segment_similarity_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut where neighbours' similarity falls below 0.05 after three frames, or after eight."""
    order = Window.partitionBy("video_id").orderBy("frame_index")
    f = frames(spark, sf_dir).withColumn("sim", dot(F.col("embedding"), F.lag("embedding").over(order)))
    s = segments.cut_when(f.withColumn("drop", F.col("sim") < 0.05), "drop", 3, 8)
    return s.groupBy("video_id", "segment").agg(F.min("frame_index").cast("long").alias("first_frame"), F.count(F.lit(1)).alias("members"))


def segment_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut after eight frames, or where the gap exceeds twice the video's median after three."""
    order = Window.partitionBy("video_id").orderBy("frame_index")
    tl = timeline(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(order))
    median = tl.groupBy("video_id").agg((2 * F.median("gap")).alias("limit"))
    s = segments.cut_when(tl.join(median, "video_id").withColumn("wide", F.col("gap") > F.col("limit")), "wide", 3, 8)
    return s.groupBy("video_id", "segment").agg(F.min("frame_index").cast("long").alias("first_frame"), F.count(F.lit(1)).alias("members"))


def fixed_count_events(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """Events of four turns each: range and text."""
    c = captions(spark, sf_dir).withColumn("event", F.floor(F.col("frame_index") / size).cast("long"))
    g = c.groupBy("video_id", "event").agg(F.min("frame_index").alias("lo"), (F.max("frame_index") + 1).alias("hi"), F.array_sort(F.collect_list(F.struct("frame_index", "caption"))).alias("x"))
    text = F.concat(F.format_string("[%d-%ds] ", "lo", "hi"), F.array_join(F.transform("x", lambda y: y["caption"]), " "))
    return g.select("video_id", "event", "lo", "hi", F.md5(text).alias("text_md5"))


def neighbor_events(spark: SparkSession, sf_dir: str, size: int = 2) -> DataFrame:
    """The longest event of each conversation with its neighbours on either side."""
    c = captions(spark, sf_dir).withColumn("event", F.floor(F.col("frame_index") / size).cast("long"))
    e = c.groupBy("video_id", "event").agg(F.sum(F.length("caption")).alias("chars"))
    best = e.groupBy("video_id").agg(F.max_by("event", F.struct("chars", -F.col("event"))).alias("best"))
    return e.join(best, "video_id").where("event BETWEEN best - 1 AND best + 1").select("video_id", "event", "best", "chars")


def tumbling_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of 160 units, with the frame in the middle of each."""
    c = segments.tumbling_clips(timeline(spark, sf_dir), 160.0)
    g = c.groupBy("video_id", "clip").agg(F.array_sort(F.collect_list("frame_index")).alias("x"))
    return g.select("video_id", "clip", F.size("x").cast("long").alias("members"), F.element_at("x", F.floor(F.size("x") / 2).cast("int") + 1).alias("middle"))


def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segments.gap_clusters(timeline(spark, sf_dir), 30.0)
    return c.groupBy("video_id", "cluster").agg(F.min("frame_index").alias("first_frame"), F.count(F.lit(1)).alias("members"))


def shot_boundaries(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Frames whose mean colour differs from the last frame with pixels by more than half the scale; frames without pixels are passed over."""
    cents = F.floor(F.col("value") * 100).cast("long")
    pixels = timeline(spark, sf_dir).where("event_type <> 'signup'")
    order = Window.partitionBy("video_id").orderBy("frame_index")
    apart = sum((F.abs(cents * m % 256 - F.lag(cents * m % 256).over(order)) for m in (7, 13, 29)), F.lit(0)) / (3 * 255.0)
    return pixels.withColumn("jump", apart).where(F.col("jump") > threshold).select("video_id", "frame_index")


def focus_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of an eighth of the frames (four at least) with the largest value."""
    width = F.least(F.col("n"), F.greatest(F.lit(4).cast("long"), F.floor(F.col("n") / 8).cast("long")))
    return segments.best_window(timeline(spark, sf_dir), width, "value").select("video_id", "start", "width", F.round("total", 4).alias("total"))


def multi_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of overview, and the focus window's frames that it lacks."""
    tl = timeline(spark, sf_dir)
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 8).cast("long"))
    overview = tl.where((F.col("frame_index") % step == 0) & (F.floor(F.col("frame_index") / step) < 8)).select("video_id", "frame_index", F.lit("overview").alias("scale"))
    w = focus_window(spark, sf_dir)
    focus = tl.join(w, "video_id").where("frame_index >= start AND frame_index < start + width").select("video_id", "frame_index", F.lit("focus").alias("scale"))
    return overview.unionByName(focus.join(overview, ["video_id", "frame_index"], "left_anti"))


def pool_step_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("frame_index")
    d = timeline(spark, sf_dir).withColumn("d", F.col("t") - F.lag("t").over(order))
    return d.groupBy("video_id").agg(F.round(F.greatest(F.lit(1.0), F.coalesce(F.median("d"), F.lit(6.0))), 6).alias("step"))


def rr_budget_split(spark: SparkSession, sf_dir: str, want: int = 24) -> DataFrame:
    """A budget split over the five highest values by reciprocal rank, two at least."""
    order = Window.partitionBy("video_id").orderBy(F.desc("value"), "frame_index")
    r = timeline(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 5").withColumn("w", 1 / F.col("r"))
    share = F.bround(F.col("w") * want / F.sum("w").over(Window.partitionBy("video_id")), 0).cast("long")
    return r.select("video_id", "frame_index", F.greatest(F.lit(2).cast("long"), share).alias("frames"))


def width_allocation(spark: SparkSession, sf_dir: str, want: int = 40) -> DataFrame:
    """A budget over clusters in proportion to their length, between four and all."""
    c = segments.gap_clusters(timeline(spark, sf_dir), 30.0).groupBy("video_id", "cluster").agg((F.max("t") - F.min("t") + 1).alias("len"))
    share = F.bround(F.lit(want) * F.col("len") / F.sum("len").over(Window.partitionBy("video_id")), 0).cast("long")
    return c.select("video_id", "cluster", F.least(F.lit(want).cast("long"), F.greatest(F.lit(4).cast("long"), share)).alias("frames"))


QUERIES = {f.__name__: f for f in (segment_similarity_drop, segment_gap, fixed_count_events, neighbor_events, tumbling_clips, session_clusters, shot_boundaries, focus_window, multi_scale, pool_step_median, rr_budget_split, width_allocation)}

_FOLD = """x AS (SELECT video_id, frame_index, {flag} AS wanted FROM {src}), walk(video_id, frame_index, len, segment) AS (
SELECT video_id, frame_index, 1::BIGINT, 0::BIGINT FROM x WHERE frame_index = 0 UNION ALL
SELECT x.video_id, x.frame_index, CASE WHEN w.len >= 8 OR (w.len >= 3 AND coalesce(x.wanted, false)) THEN 1 ELSE w.len + 1 END, CASE WHEN w.len >= 8 OR (w.len >= 3 AND coalesce(x.wanted, false)) THEN w.segment + 1 ELSE w.segment END
FROM walk w JOIN x ON x.video_id = w.video_id AND x.frame_index = w.frame_index + 1)
SELECT video_id, segment, min(frame_index) AS first_frame, count(*) AS members FROM walk GROUP BY 1, 2"""
_CLUSTERS = "c0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t, frame_index) > 30.0 THEN 1 ELSE 0 END AS fresh FROM tl), c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY video_id ORDER BY t, frame_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM c0)"
_FOCUS = """w AS (SELECT *, least(n, greatest(4, n // 8)) AS width, sum(value) OVER (PARTITION BY video_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS s FROM tl),
e AS (SELECT a.video_id, a.frame_index - a.width + 1 AS start, a.width, round(a.s - coalesce(b.s, 0), 6) AS total FROM w a LEFT JOIN w b ON b.video_id = a.video_id AND b.frame_index = a.frame_index - a.width WHERE a.frame_index >= a.width - 1),
focus AS (SELECT video_id, start, width, round(total, 4) AS total FROM e QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY total DESC, start) = 1)"""
ORACLE = {
    "segment_similarity_drop": f"WITH RECURSIVE {FRAMES_SQL}, s AS (SELECT video_id, frame_index, list_inner_product(e, lag(e) OVER (PARTITION BY video_id ORDER BY frame_index)) AS sim FROM frames), " + _FOLD.format(flag="sim < 0.05", src="s"),
    "segment_gap": f"WITH RECURSIVE {TIMELINE_SQL}, g AS (SELECT video_id, frame_index, t - lag(t) OVER (PARTITION BY video_id ORDER BY frame_index) AS gap FROM tl), m AS (SELECT *, 2 * median(gap) OVER (PARTITION BY video_id) AS lim FROM g), " + _FOLD.format(flag="gap > lim", src="m"),
    "fixed_count_events": "WITH c AS (SELECT conv_id AS video_id, turn, text, turn // 4 AS event FROM conversations), g AS (SELECT video_id, event, min(turn) AS lo, max(turn) + 1 AS hi, string_agg(text, ' ' ORDER BY turn, text) AS x FROM c GROUP BY 1, 2) SELECT video_id, event, lo, hi, md5('[' || lo || '-' || hi || 's] ' || x) AS text_md5 FROM g",
    "neighbor_events": "WITH e AS (SELECT conv_id AS video_id, turn // 2 AS event, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1, 2), b AS (SELECT video_id, event AS best FROM e QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY chars DESC, event) = 1) SELECT e.video_id, event, best, chars FROM e JOIN b USING (video_id) WHERE event BETWEEN best - 1 AND best + 1",
    "tumbling_clips": f"WITH {TIMELINE_SQL}, c AS (SELECT video_id, frame_index, CAST(floor(t / 160.0) AS BIGINT) AS clip, t FROM tl), u AS (SELECT video_id, frame_index, clip FROM c UNION ALL SELECT video_id, frame_index, clip - 1 FROM c WHERE t - clip * 160.0 <= 1e-6 AND clip > 0), g AS (SELECT video_id, clip, list(frame_index ORDER BY frame_index) AS x FROM u GROUP BY 1, 2) SELECT video_id, clip, len(x) AS members, x[len(x) // 2 + 1] AS middle FROM g",
    "session_clusters": f"WITH {TIMELINE_SQL}, {_CLUSTERS} SELECT video_id, cluster, min(frame_index) AS first_frame, count(*) AS members FROM c GROUP BY 1, 2",
    "shot_boundaries": f"WITH {TIMELINE_SQL}, c AS (SELECT video_id, frame_index, CAST(floor(value * 100) AS BIGINT) AS c FROM tl WHERE event_type <> 'signup'), j AS (SELECT video_id, frame_index, (abs(c * 7 % 256 - lag(c * 7 % 256) OVER w) + abs(c * 13 % 256 - lag(c * 13 % 256) OVER w) + abs(c * 29 % 256 - lag(c * 29 % 256) OVER w)) / 765.0::DOUBLE AS jump FROM c WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)) SELECT video_id, frame_index FROM j WHERE jump > 0.5",
    "focus_window": f"WITH {TIMELINE_SQL}, {_FOCUS} SELECT * FROM focus",
    "multi_scale": f"WITH {TIMELINE_SQL}, {_FOCUS}, o AS (SELECT video_id, frame_index FROM tl WHERE frame_index % greatest(1, n // 8) = 0 AND frame_index // greatest(1, n // 8) < 8) SELECT *, 'overview' AS scale FROM o UNION ALL SELECT tl.video_id, tl.frame_index, 'focus' FROM tl JOIN focus f ON f.video_id = tl.video_id AND tl.frame_index >= start AND tl.frame_index < start + width ANTI JOIN o ON o.video_id = tl.video_id AND o.frame_index = tl.frame_index",
    "pool_step_median": f"WITH {TIMELINE_SQL}, d AS (SELECT video_id, t - lag(t) OVER (PARTITION BY video_id ORDER BY frame_index) AS d FROM tl) SELECT video_id, round(greatest(1.0::DOUBLE, coalesce(median(d), 6.0)), 6) AS step FROM d GROUP BY 1",
    "rr_budget_split": f"WITH {TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, frame_index) AS r FROM tl), w AS (SELECT *, 1::DOUBLE / r AS w FROM r WHERE r <= 5) SELECT video_id, frame_index, greatest(2, CAST(round_even(w * 24 / sum(w) OVER (PARTITION BY video_id), 0) AS BIGINT)) AS frames FROM w",
    "width_allocation": f"WITH {TIMELINE_SQL}, {_CLUSTERS}, l AS (SELECT video_id, cluster, max(t) - min(t) + 1 AS len FROM c GROUP BY 1, 2) SELECT video_id, cluster, least(40, greatest(4, CAST(round_even(40 * len / sum(len) OVER (PARTITION BY video_id), 0) AS BIGINT))) AS frames FROM l",
}
