"""Programs that aim before they look: named moments, spans refined step by step, stated addresses, and a second look."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions import text as tx
from tempora.operators import intervals, sampling, selection
from tempora.operators.vector import dot
from tempora.plans.selection import _SCALED, _SCORED, _aks, scored
from tempora.sources.tables import TIMELINE_SQL, timeline

FPS = 2.0
BURST_SHARE, LEAST_HALF, STEPS = 0.6, 6.0, 1.5
NARROW, SHORT_UNION, THIN_POOL, LEAST_GAIN = 0.0625, 90.0, 12, 2.0
ADDRESS_SHARE, PAD, LEAST_STRIDE = 0.5, 3.0, 0.7
VERIFY_SHARE = 0.25


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their similarity (``sim``), scaled scores and number in the video."""
    every = Window.partitionBy("video_id")
    s = scored(spark, sf_dir).withColumn("sim", F.col("score")).withColumn("score", F.round(selection.minmax("score", "video_id"), 9))
    return s.withColumn("n", F.count(F.lit(1)).over(every))


def _merged(first: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """Frames of either (the first one's origin wins), the earliest ``k`` of each video."""
    both = first.unionByName(rest.join(first, ["video_id", "frame_index"], "left_anti"))
    order = Window.partitionBy("video_id").orderBy("frame_index")
    return both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def survey_commit(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """Bursts around surveyed moments, the first named longest; adaptive keyframes over the whole video for the rest.

    A video's survey names up to three moments (some videos none: then keyframes alone).
    """
    s = _scaled(spark, sf_dir)
    v = s.select("video_id", "n").distinct().withColumn("dur", F.col("n") / FPS)
    moments = F.filter(F.array(*[F.col("video_id") * a % 29 + b for a, b in ((7, 2.0), (11, 9.0), (3, 14.5))]), lambda t: t <= F.col("dur"))
    v = v.withColumn("moments", F.when(F.col("video_id") % 4 == 3, F.array().cast("array<double>")).otherwise(F.array_distinct(moments)))
    c = v.select("*", F.posexplode("moments").alias("i", "t"))
    weight = 1 / (F.col("i") + 1)
    want = round(k * BURST_SHARE)
    share = F.greatest(F.lit(2).cast("long"), F.bround(want * weight / F.sum(weight).over(Window.partitionBy("video_id")), 0).cast("long"))
    half = max(LEAST_HALF, STEPS / FPS)
    at = sampling.range_indexes(F.col("n"), F.lit(FPS), F.greatest(F.lit(0.0), F.col("t") - half), F.least("dur", F.col("t") + half), F.col("share"))
    burst = c.withColumn("share", share).where(F.least("dur", F.col("t") + half) > F.greatest(F.lit(0.0), F.col("t") - half))
    burst = burst.select("video_id", F.explode(at).alias("frame_index")).distinct().withColumn("origin", F.lit("burst"))
    left = v.join(burst.groupBy("video_id").agg(F.count(F.lit(1)).alias("have")), "video_id", "left")
    left = left.select("video_id", F.when(F.col("have").isNull(), F.lit(k)).otherwise(F.greatest(F.lit(1).cast("long"), k - F.col("have"))).alias("rest"))
    anchors = selection.adaptive_keyframes(s.join(left, "video_id"), "rest").withColumn("origin", F.lit("anchor"))
    return _merged(burst, anchors, k)


def ladder_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer's first centres (three errors), the spans kept around them, and why the next rung is or is not taken.

    A video is a user's timeline at one frame a unit; the next rung's pointer names the purchases.
    """
    tl = timeline(spark, sf_dir)
    order = Window.partitionBy("video_id").orderBy("t", "frame_index")
    steps = tl.withColumn("d", F.col("t") - F.lag("t").over(order))
    v = steps.groupBy("video_id").agg(F.max("t").alias("dur"), F.count(F.lit(1)).alias("want"), F.greatest(F.lit(1.0), F.coalesce(F.median("d"), F.lit(6.0))).alias("step"))
    centres = tl.where("event_type = 'error'").withColumn("r", F.row_number().over(order)).where("r <= 3").join(v, "video_id")
    half = NARROW * F.col("dur")
    spans = intervals.merge(centres.select("video_id", F.greatest(F.lit(0.0), F.col("t") - half).alias("lo"), F.least("dur", F.col("t") + half).alias("hi")).where("hi > lo"))
    # The pool: each span in proportion to its length, a grid's row at least.
    s = spans.join(v, "video_id").withColumn("union", F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("video_id")))
    n = F.greatest(F.lit(4).cast("long"), F.least("want", F.bround(F.col("want") * (F.col("hi") - F.col("lo")) / F.col("union"), 0).cast("long")))
    at = sampling.range_indexes(F.floor("dur").cast("long") + 1, F.lit(1.0), F.col("lo"), F.col("hi"), F.greatest(n, F.lit(1)))
    pool = s.select("video_id", F.explode(at).alias("at")).distinct()
    gaps = pool.withColumn("d", F.col("at") - F.lag("at").over(Window.partitionBy("video_id").orderBy("at")))
    seen = gaps.groupBy("video_id").agg(F.count(F.lit(1)).alias("pool"), F.median("d").alias("fine"))
    bought = intervals.inside(tl.where("event_type = 'purchase'"), spans, "left_semi").groupBy("video_id").agg(F.count(F.lit(1)).alias("inside"))
    u = spans.groupBy("video_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("union"))
    r = v.join(u, "video_id").join(seen, "video_id").join(bought, "video_id", "left")
    stop = (
        F.when(F.round("union", 6) <= SHORT_UNION, "union_short")
        .when(F.col("pool") < THIN_POOL, "pool_thin")
        .when((F.coalesce("fine", "step") <= 0) | (F.round(F.col("step") / F.coalesce("fine", "step"), 6) < LEAST_GAIN), "no_res_gain")
        .when(F.col("inside").isNull(), "nothing_inside")
        .otherwise("refined")
    )
    return r.select("video_id", F.round("union", 4).alias("union_s"), "pool", stop.alias("stop"), F.when(stop == "refined", F.round("union", 4)).otherwise(F.round("dur", 4)).alias("final_span"))


def _addresses(f: DataFrame) -> DataFrame:
    """Stated spans of each video, some beyond its end: what a question's clocks come to."""
    v = f.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).withColumn("dur", F.col("n") / FPS)
    stated = F.array(F.struct((F.col("video_id") % 13 + 1.0).alias("lo"), (F.col("video_id") % 13 + 4.0).alias("hi")), F.struct(F.lit(9.0).alias("lo"), F.lit(9.0).alias("hi")), F.struct(F.lit(1e6).alias("lo"), F.lit(1e6).alias("hi")))
    return v.withColumn("x", F.explode(F.filter(stated, lambda s: (s["hi"] <= F.col("dur")) & (F.col("video_id") % 5 != 4)))).select("video_id", "n", "dur", "x.lo", "x.hi")


def address_decode(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """Half the budget inside the stated spans, padded and merged; best frames by similarity elsewhere fill the rest.

    Spans share by width, never denser than a frame each 0.7 s. Without an address the best frames stand alone.
    """
    s = _scaled(spark, sf_dir)
    spans = _addresses(s)
    covered = intervals.merge(spans.select("video_id", F.greatest(F.lit(0.0), F.col("lo") - PAD).alias("lo"), (F.col("hi") + PAD).alias("hi")))
    every = Window.partitionBy("video_id")
    budget = int(k * ADDRESS_SHARE)
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-3))
    c = covered.join(s.select("video_id", "n").distinct(), "video_id").withColumn("m", F.count(F.lit(1)).over(every))
    share = F.when(F.col("m") == 1, F.lit(budget).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.bround(budget * width / F.sum(width).over(every), 0).cast("long")))
    share = F.least(share, F.greatest(F.lit(1).cast("long"), F.floor((F.col("hi") - F.col("lo")) / LEAST_STRIDE).cast("long") + 1))
    at = sampling.range_indexes(F.col("n"), F.lit(FPS), F.col("lo"), F.col("hi"), F.col("share"))
    first = c.withColumn("share", share).select("video_id", F.explode(at).alias("frame_index")).distinct()
    first = first.withColumn("r", F.row_number().over(every.orderBy("frame_index"))).where(f"r <= {budget}").select("video_id", "frame_index", F.lit("address").alias("origin"))
    best = s.withColumn("r", F.row_number().over(every.orderBy(F.desc("sim"), "frame_index"))).where(f"r <= {k}")
    context = intervals.inside(best.select("video_id", "frame_index", "ts"), covered, "left_anti", t="ts")
    have = first.groupBy("video_id").agg(F.count(F.lit(1)).alias("have"))
    context = context.join(have, "video_id", "left").withColumn("r", F.row_number().over(every.orderBy("frame_index"))).where(k - F.coalesce("have", F.lit(0)) >= F.col("r"))
    return first.unionByName(context.select("video_id", "frame_index", F.lit("context").alias("origin")))


def verify_relook(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """The best frames for the question, then a quarter of the budget on those nearest to the tentative option.

    The option's vector is that of the frame it is read from.
    """
    s = scored(spark, sf_dir).select("video_id", "frame_index", "embedding", "score")
    look = max(1, int(k * VERIFY_SHARE))
    every = Window.partitionBy("video_id")
    first = s.withColumn("r", F.row_number().over(every.orderBy(F.desc("score"), "frame_index"))).where(f"r <= {k - look}").select("video_id", "frame_index", F.lit("first").alias("turn"))
    option = s.where(F.col("frame_index") == F.col("video_id") % 4 + 1).select("video_id", F.col("embedding").alias("option"))
    again = s.join(option, "video_id").withColumn("near", F.round(dot(F.col("embedding"), F.col("option")), 9))
    again = again.withColumn("r", F.row_number().over(every.orderBy(F.desc("near"), "frame_index"))).where(f"r <= {look}").select("video_id", "frame_index", F.lit("verify").alias("turn"))
    return first.unionByName(again)


def timestamped_keyframes(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """Three quarters of the budget inside an anchored window and a thin context outside; keyframes without an anchor."""
    s = _scaled(spark, sf_dir)
    anchored = F.col("video_id") % 3 != 0
    lo, hi = F.greatest(F.lit(0.0), F.col("video_id") % 11 - 6.0), F.col("video_id") % 11 + 6.0
    dense, thin = round(k * 0.75), max(1, k - round(k * 0.75))
    a = s.where(anchored)
    inside = sampling.take(a, sampling.range_indexes(F.col("n"), F.lit(FPS), lo, hi, F.lit(dense))).select("video_id", "frame_index", F.lit("dense").alias("origin"))
    around = sampling.stride(a, thin).where(~F.col("ts").between(lo, hi)).select("video_id", "frame_index", F.lit("context").alias("origin"))
    parent = selection.adaptive_keyframes(s.where(~anchored), k).withColumn("origin", F.lit("keyframe"))
    return _merged(inside, around, k).unionByName(parent)


def navigate_episodes(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    """Events of eight frames that a reply picks (four at most; the first three where it names none), ten frames in all, in the order picked."""
    s = _scaled(spark, sf_dir)
    picks = F.when(F.col("video_id") % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array((F.col("video_id") % 5).cast("int"), F.lit(1), F.lit(3)))
    v = s.select("video_id", "n").distinct().select("video_id", "n", F.posexplode(F.array_distinct(picks)).alias("turn", "event"))
    v = v.where("event < ceil(n / 8)")
    f = s.withColumn("event", F.floor(F.col("frame_index") / 8).cast("int")).join(v.select("video_id", "turn", "event"), ["video_id", "event"])
    order = Window.partitionBy("video_id").orderBy("turn", "frame_index")
    return f.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("video_id", "event", "frame_index", "place")


def route_and_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five frames by text for every question; four by image too, unless the question asks for reasons."""
    s = scored(spark, sf_dir).withColumn("text_score", F.round(F.element_at("embedding", 1).cast("double"), 6))
    every = Window.partitionBy("video_id")
    text = s.withColumn("rank", F.row_number().over(every.orderBy(F.desc("text_score"), "frame_index"))).where("rank <= 5").select("video_id", "frame_index", F.lit("text").alias("modality"), "rank")
    question = F.element_at(F.array(F.lit("What does the sign show?"), F.lit("Why do they leave?"), F.lit("Which colour is it?")), (F.col("video_id") % 3 + 1).cast("int"))
    image = s.where(tx.route(question) == "fusion").withColumn("rank", F.row_number().over(every.orderBy(F.desc("score"), "frame_index"))).where("rank <= 4")
    return text.unionByName(image.select("video_id", "frame_index", F.lit("image").alias("modality"), "rank"))


def memory_stores(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """Frames by granularity: spread over the video for broad questions, the most similar for fine ones."""
    s = _scaled(spark, sf_dir)
    broad = F.col("video_id") % 2 == 0
    spread = sampling.stride(s.where(broad), k).select("video_id", "frame_index", F.lit("coarse").alias("grain"))
    order = Window.partitionBy("video_id").orderBy(F.desc("sim"), "frame_index")
    near = s.where(~broad).withColumn("r", F.row_number().over(order)).where(f"r <= {k}").select("video_id", "frame_index", F.lit("fine").alias("grain"))
    return spread.unionByName(near)


def event_neighbourhood(spark: SparkSession, sf_dir: str, k: int = 8, size: int = 20, reach: int = 1) -> DataFrame:
    """Frames of the best event of twenty frames and its neighbours, thinned to the budget."""
    s = _scaled(spark, sf_dir).withColumn("event", F.floor(F.col("frame_index") / size).cast("long"))
    e = s.groupBy("video_id", "event").agg(F.round(F.avg("sim"), 9).alias("mean"))
    best = e.groupBy("video_id").agg(F.max_by("event", F.struct("mean", -F.col("event"))).alias("best"))
    inside = s.join(best, "video_id").where(F.col("event").between(F.col("best") - reach, F.col("best") + reach))
    every = Window.partitionBy("video_id")
    inside = inside.withColumn("at", F.row_number().over(every.orderBy("frame_index")) - 1).withColumn("m", F.count(F.lit(1)).over(every))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("m") / k).cast("long"))
    return inside.where((F.col("at") % step == 0) & (F.floor(F.col("at") / step) < k)).select("video_id", "best", "frame_index")


def planner_loop(spark: SparkSession, sf_dir: str, most: int = 8) -> DataFrame:
    """Each user's events as a planner's actions: views retrieve, clicks inspect, a purchase stops; eight steps at most."""
    tl = timeline(spark, sf_dir)
    upto = Window.partitionBy("video_id").orderBy("frame_index")
    action = F.when(F.col("event_type") == "purchase", "Stop").when(F.col("event_type") == "click", "VisualInspect").otherwise("VisualRetrieve")
    s = tl.where(F.col("frame_index") < most).withColumn("action", action)
    s = s.withColumn("stopped", F.coalesce(F.max(F.col("action") == "Stop").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).where("NOT stopped")
    g = s.groupBy("video_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("action") == "VisualInspect").alias("inspected"), F.max_by("action", "frame_index").alias("last"))
    return g.select("video_id", "steps", "inspected", F.when(F.col("last") == "Stop", "stop").when(F.col("steps") >= most, "limit").otherwise("end").alias("ended"))


def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting questions answered from a tally: what is listed names the option; an empty or odd tally falls back."""
    tl = timeline(spark, sf_dir).where("event_type = 'click' AND frame_index < 12")
    g = tl.groupBy("video_id").agg(F.array_sort(F.collect_list("frame_index")).alias("x"))
    listed = F.array_join(F.transform("x", lambda i: F.concat((i + 1).cast("string"), F.lit(". a click"))), "\n")
    items = F.size(tx.ledger_items(F.when(F.col("video_id") % 6 == 0, F.lit("NONE")).otherwise(listed)))
    numbers = F.array(*[F.lit(o) for o in ("A. 1", "B. 2", "C. 3", "D. 4")])
    gate = tx.is_cardinality(F.when(F.col("video_id") % 4 == 0, F.lit("What colour?")).otherwise(F.lit("How many clicks?")), numbers)
    place = F.array_position(tx.option_quantities(numbers), items.cast("double"))
    told = F.when(gate & (items > 0) & (place > 0), F.char(place + 64))
    return g.select("video_id", gate.alias("gated"), items.alias("items"), F.coalesce(told, F.lit("A")).alias("letter"), F.when(told.isNotNull(), "ledger").otherwise("parent_direct").alias("source"))


QUERIES = {f.__name__: f for f in (survey_commit, ladder_refine, address_decode, verify_relook, timestamped_keyframes, navigate_episodes, route_and_retrieve, memory_stores, event_neighbourhood, planner_loop, ledger_reconcile)}

_AT = "CASE WHEN kk = 1 THEN a ELSE CAST(round_even(a + CAST(i AS DOUBLE) * (b - a) / (kk - 1), 0) AS BIGINT) END AS frame_index"
ORACLE = {
    "survey_commit": f"""WITH RECURSIVE {_SCALED}, v AS (SELECT DISTINCT video_id, n, n / 2.0::DOUBLE AS dur FROM sc),
m AS (SELECT video_id, n, dur, j, (video_id * ([7, 11, 3])[j] % 29 + ([2.0, 9.0, 14.5])[j])::DOUBLE AS t FROM v, range(1, 4) x(j) WHERE video_id % 4 <> 3),
d AS (SELECT video_id, n, dur, t, min(j) AS j FROM m WHERE t <= dur GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY j) AS pos FROM d),
w AS (SELECT *, greatest(2, CAST(round_even(10 * (1.0::DOUBLE / pos) / sum(1.0::DOUBLE / pos) OVER (PARTITION BY video_id), 0) AS BIGINT)) AS share, greatest(0.0, t - 6) AS lo, least(dur, t + 6) AS hi FROM c),
q AS (SELECT *, greatest(0, least(CAST(round_even(lo * 2, 0) AS BIGINT), n - 1)) AS a FROM w WHERE hi > lo), q2 AS (SELECT *, greatest(a, least(CAST(round_even(hi * 2, 0) AS BIGINT), n - 1)) AS b FROM q), q3 AS (SELECT *, greatest(1, least(share, b - a + 1)) AS kk FROM q2),
burst AS (SELECT DISTINCT video_id, {_AT} FROM q3, range(16) r(i) WHERE i < kk),
h AS (SELECT v.video_id, CASE WHEN count(burst.frame_index) = 0 THEN 16 ELSE greatest(1, 16 - count(burst.frame_index)) END AS rest FROM v LEFT JOIN burst USING (video_id) GROUP BY 1), sk AS (SELECT sc.*, h.rest FROM sc JOIN h USING (video_id)), {_aks('rest', 'sk')},
u AS (SELECT video_id, frame_index, 'burst' AS origin FROM burst UNION ALL SELECT video_id, frame_index, 'anchor' FROM aks ANTI JOIN burst USING (video_id, frame_index))
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_index) <= 16""",
    "ladder_refine": f"""WITH {TIMELINE_SQL}, st AS (SELECT *, t - lag(t) OVER (PARTITION BY video_id ORDER BY t, frame_index) AS d FROM tl), v AS (SELECT video_id, max(t) AS dur, count(*) AS want, greatest(1.0, coalesce(median(d), 6.0)) AS step FROM st GROUP BY 1),
c AS (SELECT video_id, t FROM tl WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t, frame_index) <= 3),
s0 AS (SELECT video_id, greatest(0.0, t - 0.0625 * dur) AS lo, least(dur, t + 0.0625 * dur) AS hi FROM c JOIN v USING (video_id)), s1 AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS fresh FROM s0 WHERE hi > lo),
s2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM s1), sp AS (SELECT video_id, island, min(lo) AS lo, max(hi) AS hi FROM s2 GROUP BY 1, 2), u AS (SELECT video_id, sum(hi - lo) AS un FROM sp GROUP BY 1),
q AS (SELECT sp.video_id, lo, hi, dur, greatest(4, least(want, CAST(round_even(want * (hi - lo) / un, 0) AS BIGINT))) AS share, CAST(floor(dur) AS BIGINT) + 1 AS n FROM sp JOIN u USING (video_id) JOIN v USING (video_id)),
q1 AS (SELECT *, greatest(0, least(CAST(round_even(lo, 0) AS BIGINT), n - 1)) AS a FROM q), q2 AS (SELECT *, greatest(a, least(CAST(round_even(hi, 0) AS BIGINT), n - 1)) AS b FROM q1), q3 AS (SELECT *, greatest(1, least(share, b - a + 1)) AS kk FROM q2),
p AS (SELECT DISTINCT video_id, {_AT} FROM q3, range(100000) r(i) WHERE i < kk), g AS (SELECT *, frame_index - lag(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index) AS d FROM p), e AS (SELECT video_id, count(*) AS pool, median(d) AS fine FROM g GROUP BY 1),
b AS (SELECT tl.video_id, count(*) AS inside FROM tl WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM sp WHERE sp.video_id = tl.video_id AND tl.t BETWEEN lo AND hi) GROUP BY 1),
x AS (SELECT v.video_id, un, pool, dur, CASE WHEN round(un, 6) <= 90 THEN 'union_short' WHEN pool < 12 THEN 'pool_thin' WHEN coalesce(fine, step) <= 0 OR round(step / coalesce(fine, step), 6) < 2 THEN 'no_res_gain' WHEN inside IS NULL THEN 'nothing_inside' ELSE 'refined' END AS stop FROM v JOIN u USING (video_id) JOIN e USING (video_id) LEFT JOIN b USING (video_id))
SELECT video_id, round(un, 4) AS union_s, pool, stop, CASE WHEN stop = 'refined' THEN round(un, 4) ELSE round(dur, 4) END AS final_span FROM x""",
    "address_decode": f"""WITH {_SCALED}, v AS (SELECT DISTINCT video_id, n, n / 2.0::DOUBLE AS dur FROM sc), ad AS (SELECT * FROM (SELECT video_id, n, dur, video_id % 13 + 1.0::DOUBLE AS lo, video_id % 13 + 4.0::DOUBLE AS hi FROM v UNION ALL SELECT video_id, n, dur, 9.0, 9.0 FROM v) WHERE hi <= dur AND video_id % 5 <> 4),
p0 AS (SELECT video_id, n, greatest(0.0, lo - 3) AS lo, hi + 3 AS hi FROM ad), p1 AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS fresh FROM p0),
p2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM p1), cov AS (SELECT video_id, n, island, min(lo) AS lo, max(hi) AS hi FROM p2 GROUP BY 1, 2, 3),
w AS (SELECT *, least(CASE WHEN count(*) OVER x = 1 THEN 8 ELSE greatest(1, CAST(round_even(8 * (hi - lo) / sum(hi - lo) OVER x, 0) AS BIGINT)) END, greatest(1, CAST(floor((hi - lo) / 0.7::DOUBLE) AS BIGINT) + 1)) AS share FROM cov WINDOW x AS (PARTITION BY video_id)),
q AS (SELECT *, greatest(0, least(CAST(round_even(lo * 2, 0) AS BIGINT), n - 1)) AS a FROM w), q2 AS (SELECT *, greatest(a, least(CAST(round_even(hi * 2, 0) AS BIGINT), n - 1)) AS b FROM q), q3 AS (SELECT *, greatest(1, least(share, b - a + 1)) AS kk FROM q2),
f AS (SELECT * FROM (SELECT DISTINCT video_id, {_AT} FROM q3, range(16) r(i) WHERE i < kk) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_index) <= 8), hv AS (SELECT video_id, count(*) AS have FROM f GROUP BY 1),
best AS (SELECT video_id, frame_index, ts FROM sc QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 16), c AS (SELECT best.*, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS r FROM best WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.video_id = best.video_id AND best.ts BETWEEN lo AND hi))
SELECT video_id, frame_index, 'address' AS origin FROM f UNION ALL SELECT c.video_id, frame_index, 'context' FROM c LEFT JOIN hv USING (video_id) WHERE r <= 16 - coalesce(have, 0)""",
    "verify_relook": f"""WITH {_SCORED}, a AS (SELECT s.video_id, s.frame_index, round(list_inner_product(s.e, o.e), 9) AS near FROM s JOIN s o ON o.video_id = s.video_id AND o.frame_index = o.video_id % 4 + 1)
SELECT video_id, frame_index, 'first' AS turn FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 12) UNION ALL SELECT video_id, frame_index, 'verify' FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY near DESC, frame_index) <= 4)""",
    "timestamped_keyframes": f"""WITH RECURSIVE {_SCALED}, w AS (SELECT *, greatest(0.0, video_id % 11 - 6.0::DOUBLE) AS lo, video_id % 11 + 6.0::DOUBLE AS hi FROM sc WHERE video_id % 3 <> 0), v AS (SELECT DISTINCT video_id, n, greatest(0, least(CAST(round_even(lo * 2, 0) AS BIGINT), n - 1)) AS a, hi FROM w),
q2 AS (SELECT *, greatest(a, least(CAST(round_even(hi * 2, 0) AS BIGINT), n - 1)) AS b FROM v), q3 AS (SELECT *, greatest(1, least(12, b - a + 1)) AS kk FROM q2), d AS (SELECT DISTINCT video_id, {_AT} FROM q3, range(16) r(i) WHERE i < kk),
c AS (SELECT video_id, frame_index FROM w WHERE frame_index % greatest(1, n // 4) = 0 AND frame_index // greatest(1, n // 4) < 4 AND NOT ts BETWEEN lo AND hi), u AS (SELECT video_id, frame_index, 'dense' AS origin FROM d UNION ALL SELECT video_id, frame_index, 'context' FROM c ANTI JOIN d USING (video_id, frame_index)),
k AS (SELECT * FROM sc WHERE video_id % 3 = 0), {_aks(16, 'k')} SELECT * FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_index) <= 16) UNION ALL SELECT video_id, frame_index, 'keyframe' FROM aks""",
    "navigate_episodes": f"""WITH {_SCALED}, v AS (SELECT DISTINCT video_id, n FROM sc), p AS (SELECT video_id, n, unnest(CASE WHEN video_id % 3 = 0 THEN [0, 1, 2] ELSE [video_id % 5, 1, 3] END) AS event, unnest([0, 1, 2]) AS turn FROM v), f AS (SELECT video_id, n, event, min(turn) AS turn FROM p WHERE event < ceil(n / 8.0) GROUP BY 1, 2, 3)
SELECT sc.video_id, CAST(event AS INT) AS event, frame_index, CAST(row_number() OVER (PARTITION BY sc.video_id ORDER BY turn, frame_index) AS INT) AS place FROM sc JOIN f ON f.video_id = sc.video_id AND frame_index // 8 = event QUALIFY row_number() OVER (PARTITION BY sc.video_id ORDER BY turn, frame_index) <= 10""",
    "route_and_retrieve": f"""WITH {_SCORED}, z AS (SELECT *, round(e[1], 6) AS text_score FROM s) SELECT video_id, frame_index, 'text' AS modality, CAST(row_number() OVER (PARTITION BY video_id ORDER BY text_score DESC, frame_index) AS INT) AS rank FROM z QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY text_score DESC, frame_index) <= 5
UNION ALL SELECT * FROM (SELECT video_id, frame_index, 'image', CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) AS INT) AS rank FROM z WHERE NOT regexp_matches(lower((['What does the sign show?', 'Why do they leave?', 'Which colour is it?'])[video_id % 3 + 1]), 'why|how|reason|cause|overall|summar|purpose')) WHERE rank <= 4""",
    "memory_stores": f"""WITH {_SCALED} SELECT video_id, frame_index, 'coarse' AS grain FROM sc WHERE video_id % 2 = 0 AND frame_index % greatest(1, n // 8) = 0 AND frame_index // greatest(1, n // 8) < 8 UNION ALL SELECT video_id, frame_index, 'fine' FROM (SELECT * FROM sc WHERE video_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 8)""",
    "event_neighbourhood": f"""WITH {_SCORED}, m AS (SELECT *, frame_index // 20 AS event FROM s), b AS (SELECT video_id, event AS best FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(avg(score), 9) DESC, event) = 1),
i AS (SELECT m.video_id, best, frame_index, row_number() OVER (PARTITION BY m.video_id ORDER BY frame_index) - 1 AS p, count(*) OVER (PARTITION BY m.video_id) AS c FROM m JOIN b USING (video_id) WHERE event BETWEEN best - 1 AND best + 1) SELECT video_id, best, frame_index FROM i WHERE p % greatest(1, c // 8) = 0 AND p // greatest(1, c // 8) < 8""",
    "planner_loop": f"""WITH {TIMELINE_SQL}, f AS (SELECT video_id, min(frame_index) FILTER (WHERE event_type = 'purchase') AS stop FROM tl WHERE frame_index < 8 GROUP BY 1), s AS (SELECT tl.* FROM tl JOIN f USING (video_id) WHERE frame_index < 8 AND (stop IS NULL OR frame_index <= stop)), x AS (SELECT video_id, count(*) AS steps, count(*) FILTER (WHERE event_type = 'click') AS inspected FROM s GROUP BY 1)
SELECT x.*, CASE WHEN stop IS NOT NULL THEN 'stop' WHEN steps >= 8 THEN 'limit' ELSE 'end' END AS ended FROM x JOIN f USING (video_id)""",
    "ledger_reconcile": f"""WITH {TIMELINE_SQL}, g AS (SELECT video_id, count(*) AS c FROM tl WHERE event_type = 'click' AND frame_index < 12 GROUP BY 1), x AS (SELECT video_id, video_id % 4 <> 0 AS gated, CAST(CASE WHEN video_id % 6 = 0 THEN 0 ELSE c END AS INT) AS items FROM g)
SELECT video_id, gated, items, CASE WHEN gated AND items BETWEEN 1 AND 4 THEN chr(64 + items) ELSE 'A' END AS letter, CASE WHEN gated AND items BETWEEN 1 AND 4 THEN 'ledger' ELSE 'parent_direct' END AS source FROM x""",
}
