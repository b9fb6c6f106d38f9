"""Sampling queries over event timelines and embedded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.operators import intervals, sampling
from tempora.sources.tables import FRAMES_SQL, TIMELINE_SQL, captions, frames, table, timeline


def uniform_k(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    tl = timeline(spark, sf_dir)
    return sampling.take(tl, sampling.uniform_indexes(F.col("n"), F.lit(k))).select("video_id", "frame_index", "t")


def time_range_k(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    tl = timeline(spark, sf_dir).withColumn("fps", F.lit(0.5))
    at = sampling.range_indexes(F.col("n"), F.col("fps"), F.lit(5.0), F.lit(55.0), F.lit(k))
    return sampling.take(tl, at).select("video_id", "frame_index")


def ingest_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = timeline(spark, sf_dir)
    v = tl.groupBy("video_id").agg(F.max("t").alias("duration"), F.count(F.lit(1)).alias("n"))
    budget = F.coalesce(F.nullif(F.col("video_id") % 3 * 20, F.lit(0)), F.lit(320)).cast("long")
    return v.select("video_id", "n", budget.alias("cap"), sampling.ingest_target(F.col("duration"), F.col("n"), budget).alias("target"))


def budget_ledger(spark: SparkSession, sf_dir: str, budget: int = 40, request: int = 16) -> DataFrame:
    """Requests of at most 16 frames each draw on one budget for a question."""
    c = sampling.chunked(timeline(spark, sf_dir), request, ["video_id"], ["frame_index"])
    asked = c.groupBy("video_id", "chunk").agg(F.count(F.lit(1)).alias("asked"))
    before = Window.partitionBy("video_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    used = F.least(F.lit(budget), F.coalesce(F.sum("asked").over(before), F.lit(0))).cast("long")
    return asked.withColumn("used", used).select("video_id", "chunk", "asked", "used", F.least("asked", budget - F.col("used")).alias("granted"))


def stride_sample(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
    return sampling.stride(f, k).select("video_id", "frame_index", "vec_id")


def anchor_every_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where("frame_index % 10 = 0").select("video_id", "frame_index", "vec_id")


def decimate_160(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
    kept = sampling.take(f, sampling.uniform_indexes(F.col("n"), F.lit(160)))
    clock = F.format_string("[%02d:%02d]", F.floor(F.col("ts") / 60).cast("long"), F.floor(F.col("ts") % 60).cast("long"))
    return kept.select("video_id", "frame_index", clock.alias("line"))


def chunk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sampling.chunked(captions(spark, sf_dir), 3, ["video_id"], ["frame_index"])
    return c.groupBy("video_id", "chunk").agg(F.count(F.lit(1)).alias("members"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))


def time_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).where(F.col("t").between(100.0 - 1e-6, 400.0 + 1e-6)).select("video_id", "frame_index", "event_id")


def clamp_first_k(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("t", "frame_index")
    return timeline(spark, sf_dir).withColumn("r", F.row_number().over(order)).where(f"r <= {k}").select("video_id", "frame_index", "t")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as spans of 60 units around their time."""
    tl = timeline(spark, sf_dir).where("event_type = 'purchase'")
    return tl.select("video_id", F.greatest(F.lit(0.0), F.col("t") - 30).alias("lo"), (F.col("t") + 30).alias("hi"))


def context_outside_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge(spans(spark, sf_dir))
    return intervals.inside(timeline(spark, sf_dir), merged, "left_anti").select("video_id", "frame_index", "event_id")


def point_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge(spans(spark, sf_dir))
    return intervals.inside(timeline(spark, sf_dir), merged, "left_semi").select("video_id", "frame_index", "event_id")


def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = intervals.merge(spans(spark, sf_dir))
    return m.select("video_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def interval_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = intervals.merge(spans(spark, sf_dir))
    return m.groupBy("video_id").agg(F.count(F.lit(1)).alias("islands"), F.round(F.sum(F.col("hi") - F.col("lo")), 4).alias("total"))


def bracket_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brackets of a sixteenth of the duration around the first three errors, clipped and merged."""
    tl = timeline(spark, sf_dir)
    dur = tl.groupBy("video_id").agg(F.max("t").alias("dur"))
    order = Window.partitionBy("video_id").orderBy("t", "frame_index")
    errors = tl.where("event_type = 'error'").withColumn("r", F.row_number().over(order)).where("r <= 3")
    b = errors.join(dur, "video_id").select("video_id", F.greatest(F.lit(0.0), F.col("t") - F.col("dur") / 16).alias("lo"), F.least("dur", F.col("t") + F.col("dur") / 16).alias("hi"))
    return intervals.merge(b).select("video_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def evidence_gap(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """How near the frames shown come to the evidence window (the first purchase, one unit to either side)."""
    tl = timeline(spark, sf_dir)
    shown = sampling.take(tl, sampling.uniform_indexes(F.col("n"), F.lit(k)))
    window = tl.where("event_type = 'purchase'").groupBy("video_id").agg((F.min("t") - 1).alias("lo"), (F.min("t") + 1).alias("hi"))
    g = intervals.gap(F.col("t"), F.col("lo"), F.col("hi"))
    return window.join(shown.select("video_id", "t"), "video_id", "left").groupBy("video_id").agg(F.round(F.min(g), 6).alias("gap"), F.coalesce(F.max(F.col("t").between(F.col("lo"), F.col("hi"))), F.lit(False)).alias("visible"), F.count("t").alias("shown"))


def pinned_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of ids, order kept, against the pool; what the pool lacks is counted."""
    pool = table(spark, sf_dir, "labels").select("doc_id").distinct()
    manifest = table(spark, sf_dir, "documents").where("doc_id % 4 < 2").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "val").otherwise("test").alias("split"))
    joined = manifest.join(pool.withColumn("there", F.lit(1)), "doc_id", "left")
    return joined.groupBy("split").agg(F.count(F.lit(1)).alias("pinned"), F.count("there").alias("found"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("missing"))


def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burst frames around errors win over anchor frames with the same index."""
    tl = timeline(spark, sf_dir)
    burst = tl.where("event_type = 'error'").select("video_id", "frame_index", F.lit("burst").alias("origin"), F.lit(0).alias("p"))
    anchor = tl.where("frame_index % 3 = 0").select("video_id", "frame_index", F.lit("anchor").alias("origin"), F.lit(1).alias("p"))
    order = Window.partitionBy("video_id", "frame_index").orderBy("p")
    return burst.unionByName(anchor).withColumn("r", F.row_number().over(order)).where("r = 1").select("video_id", "frame_index", "origin")


def candidate_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two candidate sets."""
    tl = timeline(spark, sf_dir)
    a, b = tl.where("value > 20").select("video_id", "frame_index"), tl.where("frame_index % 2 = 0").select("video_id", "frame_index")
    tag = lambda d, s: d.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(s))
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.exceptAll(b), "except"))


def pinned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's documents out of the pool of all, in its order (by a checksum); a missing one would fail the query."""
    manifest = table(spark, sf_dir, "labels").where("doc_id % 2 = 0").select("doc_id", F.left(F.md5(F.col("doc_id").cast("string")), F.lit(8)).alias("at")).dropDuplicates(["doc_id"])
    pool = table(spark, sf_dir, "documents").select("doc_id", "lang").dropDuplicates(["doc_id"])
    return sampling.pinned(manifest, pool, "doc_id", "at").select("doc_id", "at", "lang")


def linspace_thinning(spark: SparkSession, sf_dir: str, room: int = 36) -> DataFrame:
    """A pool of frames thinned evenly to what three grids of twelve hold."""
    tl = timeline(spark, sf_dir)
    return sampling.take(tl, sampling.linspace_indexes(F.col("n"), F.lit(room))).select("video_id", "frame_index")


def hard_cap_check(spark: SparkSession, sf_dir: str, cap: int = 16) -> DataFrame:
    """Requests of sixteen frames at most, under a cap that fails the query if one shows more."""
    c = sampling.chunked(timeline(spark, sf_dir), 16, ["video_id"], ["frame_index"]).groupBy("video_id", "chunk").agg(F.count(F.lit(1)).alias("frames"))
    return sampling.hard_cap(c, cap)


def ingest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was ingested over all videos: their number, frames and visual tokens a video, and frames a question."""
    tl = timeline(spark, sf_dir)
    v = tl.groupBy("video_id").agg(F.max("t").alias("duration"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("questions"))
    v = v.withColumn("frames", sampling.ingest_target(F.col("duration"), F.col("n"), F.lit(320)))
    videos = F.greatest(F.lit(1), F.count(F.lit(1)))
    return v.agg(F.count(F.lit(1)).alias("ingest_videos"), F.round(F.sum("frames") / videos, 6).alias("ingest_frames_avg"), F.round(F.sum(F.col("frames") * 64) / videos, 6).alias("ingest_tokens_avg"), F.round(F.sum("frames") / F.greatest(F.lit(1), F.sum("questions")), 6).alias("frames_per_question"))


def evidence_strata(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """Per question: the evidence window's length, the gap to the nearest frame shown, whether one lies inside, and how many do."""
    tl = timeline(spark, sf_dir)
    shown = sampling.take(tl, sampling.uniform_indexes(F.col("n"), F.lit(k))).select("video_id", F.col("t").alias("shown"))
    window = tl.where("event_type = 'purchase'").select("video_id", "event_id", F.greatest(F.lit(0.0), F.col("t") - 20).alias("lo"), (F.col("t") + F.col("value") % 50).alias("hi"))
    inside = F.col("shown").between(F.col("lo"), F.col("hi"))
    g = window.join(shown, "video_id").groupBy("event_id", "lo", "hi").agg(F.min(intervals.gap(F.col("shown"), F.col("lo"), F.col("hi"))).alias("gap"), F.count_if(inside).alias("frames"))
    return g.select("event_id", F.round(F.col("hi") - F.col("lo"), 6).alias("window_s"), F.round("gap", 6).alias("gap_s"), (F.col("frames") > 0).alias("visible_strict"), F.col("frames").alias("frames_shown"))


QUERIES = {f.__name__: f for f in (uniform_k, time_range_k, ingest_budget, budget_ledger, stride_sample, anchor_every_10, decimate_160, chunk_groups, time_window_filter, clamp_first_k, context_outside_spans, point_in_intervals, merge_intervals, interval_total, bracket_centres, evidence_gap, pinned_split, priority_union, candidate_set_ops, pinned_rows, linspace_thinning, hard_cap_check, ingest_rollup, evidence_strata)}

_UNIFORM = "SELECT DISTINCT v.video_id, CAST(floor(i * (CAST(v.n AS DOUBLE) / least({k}, v.n))) AS BIGINT) AS frame_index FROM (SELECT video_id, count(*) AS n FROM {src} GROUP BY 1) v, range({k}) r(i) WHERE i < least({k}, v.n)"
_SPANS = "spans AS (SELECT video_id, greatest(0.0, t - 30) AS lo, t + 30 AS hi FROM tl WHERE event_type = 'purchase')"
_MERGE = """m1 AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS fresh FROM spans),
m2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m1),
merged AS (SELECT video_id, island, min(lo) AS lo, max(hi) AS hi FROM m2 GROUP BY 1, 2)"""

ORACLE = {
    "uniform_k": f"WITH {TIMELINE_SQL}, pick AS ({_UNIFORM.format(k=8, src='tl')}) SELECT tl.video_id, tl.frame_index, tl.t FROM tl JOIN pick USING (video_id, frame_index)",
    "time_range_k": f"""WITH {TIMELINE_SQL}, v AS (SELECT DISTINCT video_id, n, greatest(0, least(CAST(round_even(5.0 * 0.5, 0) AS BIGINT), n - 1)) AS low FROM tl),
h AS (SELECT *, greatest(low, least(CAST(round_even(55.0 * 0.5, 0) AS BIGINT), n - 1)) AS high FROM v), k AS (SELECT *, greatest(1, least(6, high - low + 1)) AS kk FROM h)
SELECT DISTINCT video_id, CASE WHEN kk = 1 THEN low ELSE CAST(round_even(low + CAST(i AS DOUBLE) * (high - low) / (kk - 1), 0) AS BIGINT) END AS frame_index FROM k, range(6) r(i) WHERE i < kk""",
    "ingest_budget": f"""WITH {TIMELINE_SQL}, v AS (SELECT video_id, max(t) AS duration, count(*) AS n FROM tl GROUP BY 1), b AS (SELECT *, CAST(coalesce(nullif(video_id % 3 * 20, 0), 320) AS BIGINT) AS cap FROM v)
SELECT video_id, n, cap, greatest(1, least(CASE WHEN duration > 0 THEN CAST(round_even(duration * 2.0, 0) AS BIGINT) ELSE n END, cap)) AS target FROM b""",
    "budget_ledger": f"""WITH {TIMELINE_SQL}, c AS (SELECT video_id, CAST(floor(frame_index / 16) AS BIGINT) AS chunk, count(*) AS asked FROM tl GROUP BY 1, 2),
u AS (SELECT *, CAST(least(40, coalesce(sum(asked) OVER (PARTITION BY video_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS used FROM c)
SELECT video_id, chunk, asked, used, least(asked, 40 - used) AS granted FROM u""",
    "stride_sample": f"WITH {FRAMES_SQL}, c AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY video_id) // 8) AS step FROM frames) SELECT video_id, frame_index, vec_id FROM c WHERE frame_index % step = 0 AND frame_index // step < 8",
    "anchor_every_10": f"WITH {FRAMES_SQL} SELECT video_id, frame_index, vec_id FROM frames WHERE frame_index % 10 = 0",
    "decimate_160": f"WITH {FRAMES_SQL}, pick AS ({_UNIFORM.format(k=160, src='frames')}) SELECT f.video_id, f.frame_index, printf('[%02d:%02d]', CAST(floor(ts / 60) AS BIGINT), CAST(floor(ts % 60) AS BIGINT)) AS line FROM frames f JOIN pick USING (video_id, frame_index)",
    "chunk_groups": "WITH c AS (SELECT conv_id AS video_id, turn AS frame_index, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations) SELECT video_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS members, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM c GROUP BY 1, 2",
    "time_window_filter": f"WITH {TIMELINE_SQL} SELECT video_id, frame_index, event_id FROM tl WHERE t BETWEEN 100.0 - 1e-6 AND 400.0 + 1e-6",
    "clamp_first_k": f"WITH {TIMELINE_SQL} SELECT video_id, frame_index, t FROM tl QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t, frame_index) <= 5",
    "context_outside_spans": f"WITH {TIMELINE_SQL}, {_SPANS} SELECT video_id, frame_index, event_id FROM tl WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.video_id = tl.video_id AND tl.t BETWEEN s.lo AND s.hi)",
    "point_in_intervals": f"WITH {TIMELINE_SQL}, {_SPANS} SELECT video_id, frame_index, event_id FROM tl WHERE EXISTS (SELECT 1 FROM spans s WHERE s.video_id = tl.video_id AND tl.t BETWEEN s.lo AND s.hi)",
    "merge_intervals": f"WITH {TIMELINE_SQL}, {_SPANS}, {_MERGE} SELECT video_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM merged",
    "interval_total": f"WITH {TIMELINE_SQL}, {_SPANS}, {_MERGE} SELECT video_id, count(*) AS islands, round(sum(hi - lo), 4) AS total FROM merged GROUP BY 1",
    "bracket_centres": f"""WITH {TIMELINE_SQL}, d AS (SELECT video_id, max(t) AS dur FROM tl GROUP BY 1), e AS (SELECT video_id, t FROM tl WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t, frame_index) <= 3),
spans AS (SELECT e.video_id, greatest(0.0, t - dur / 16) AS lo, least(dur, t + dur / 16) AS hi FROM e JOIN d USING (video_id)), {_MERGE} SELECT video_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM merged""",
    "evidence_gap": f"""WITH {TIMELINE_SQL}, pick AS ({_UNIFORM.format(k=8, src='tl')}), shown AS (SELECT tl.video_id, tl.t FROM tl JOIN pick USING (video_id, frame_index)),
w AS (SELECT video_id, min(t) - 1 AS lo, min(t) + 1 AS hi FROM tl WHERE event_type = 'purchase' GROUP BY 1)
SELECT w.video_id, round(min(greatest(0.0, lo - t, t - hi)), 6) AS gap, coalesce(bool_or(t BETWEEN lo AND hi), false) AS visible, count(t) AS shown FROM w LEFT JOIN shown USING (video_id) GROUP BY 1""",
    "pinned_split": "WITH m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'test' END AS split FROM documents WHERE doc_id % 4 < 2), p AS (SELECT DISTINCT doc_id FROM labels) SELECT split, count(*) AS pinned, count(p.doc_id) AS found, count(*) - count(p.doc_id) AS missing FROM m LEFT JOIN p USING (doc_id) GROUP BY 1",
    "priority_union": f"WITH {TIMELINE_SQL} SELECT video_id, frame_index, CASE WHEN event_type = 'error' THEN 'burst' ELSE 'anchor' END AS origin FROM tl WHERE event_type = 'error' OR frame_index % 3 = 0",
    "candidate_set_ops": f"""WITH {TIMELINE_SQL} SELECT video_id, count(*) AS n, 'union' AS op FROM tl WHERE value > 20 OR frame_index % 2 = 0 GROUP BY 1
UNION ALL SELECT video_id, count(*), 'intersect' FROM tl WHERE value > 20 AND frame_index % 2 = 0 GROUP BY 1 UNION ALL SELECT video_id, count(*), 'except' FROM tl WHERE value > 20 AND frame_index % 2 <> 0 GROUP BY 1""",
    "pinned_rows": "SELECT DISTINCT l.doc_id, left(md5(l.doc_id::VARCHAR), 8) AS \"at\", d.lang FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id % 2 = 0",
    "linspace_thinning": f"WITH {TIMELINE_SQL}, v AS (SELECT DISTINCT video_id, n FROM tl) SELECT DISTINCT video_id, CASE WHEN n <= 36 THEN i ELSE CAST(round_even(CAST(i AS DOUBLE) * (n - 1) / 35, 0) AS BIGINT) END AS frame_index FROM v, range(36) r(i) WHERE i < n",
    "hard_cap_check": f"WITH {TIMELINE_SQL} SELECT video_id, frame_index // 16 AS chunk, count(*) AS frames FROM tl GROUP BY 1, 2",
    "ingest_rollup": f"""WITH {TIMELINE_SQL}, v AS (SELECT video_id, max(t) AS dur, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS q FROM tl GROUP BY 1), f AS (SELECT *, greatest(1, least(320, CASE WHEN dur > 0 THEN CAST(round_even(dur * 2, 0) AS BIGINT) ELSE n END)) AS f FROM v)
SELECT count(*) AS ingest_videos, round(sum(f) / count(*)::DOUBLE, 6) AS ingest_frames_avg, round(sum(f * 64) / count(*)::DOUBLE, 6) AS ingest_tokens_avg, round(sum(f) / greatest(1, sum(q))::DOUBLE, 6) AS frames_per_question FROM f""",
    "evidence_strata": f"""WITH {TIMELINE_SQL}, pick AS ({_UNIFORM.format(k=8, src='tl')}), sh AS (SELECT tl.video_id, tl.t AS shown FROM tl JOIN pick USING (video_id, frame_index)), w AS (SELECT video_id, event_id, greatest(0.0, t - 20) AS lo, t + value % 50 AS hi FROM tl WHERE event_type = 'purchase')
SELECT event_id, round(hi - lo, 6) AS window_s, round(min(greatest(0.0, lo - shown, shown - hi)), 6) AS gap_s, bool_or(shown BETWEEN lo AND hi) AS visible_strict, count(*) FILTER (WHERE shown BETWEEN lo AND hi) AS frames_shown FROM w JOIN sh USING (video_id) GROUP BY event_id, lo, hi""",
}
