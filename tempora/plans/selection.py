"""Selection queries: scored frames to a budgeted, chronological few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.operators import sampling, segments, selection
from tempora.operators.vector import dot
from tempora.sources.tables import FRAMES_SQL, frames


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their similarity to the video's first vector."""
    f = frames(spark, sf_dir)
    ask = f.where("frame_index = 0").select("video_id", F.col("embedding").alias("query"))
    return f.join(ask, "video_id").select("video_id", "frame_index", "ts", "vec_id", "embedding", F.round(dot(F.col("embedding"), F.col("query")), 9).alias("score"))


def _top(d: DataFrame, k: int, *group: str, score: str = "score") -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), "frame_index")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def global_topk_single_query(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The frames of all videos nearest to one question (the smallest id's vector)."""
    f = frames(spark, sf_dir)
    ask = f.orderBy("vec_id").limit(1).select(F.col("embedding").alias("query"))
    s = f.crossJoin(F.broadcast(ask)).select("vec_id", "video_id", F.round(dot(F.col("embedding"), F.col("query")), 6).alias("score"))
    return s.orderBy(F.desc("score"), "vec_id").limit(k)


def hybrid_topk(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """0.6 navigation (two stated spans) and 0.4 scaled similarity."""
    spans = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((2.0, 4.0), (10.0, 11.0))])
    s = scored(spark, sf_dir).withColumn("sim", selection.minmax("score", "video_id", 0.5, 1e-6))
    s = s.withColumn("mixed", F.round(0.6 * selection.span_decay(F.col("ts"), spans) + 0.4 * F.col("sim"), 6))
    return _top(s, k, "video_id", score="mixed").select("video_id", "frame_index", "mixed", "rank")


def aks_select_k(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("score", F.round(selection.minmax("score", "video_id"), 9))
    return selection.adaptive_keyframes(s, k).select("video_id", "frame_index")


def mmr_select(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    s = scored(spark, sf_dir).withColumnRenamed("score", "relevance").select("video_id", "frame_index", "embedding", "relevance")
    return selection.mmr(s, k, 0.6, "video_id long, frame_index long, pick long", "video_id")


def coarse_to_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen best, clustered by gaps of ten seconds, the six best clusters (higher one first of equals), two frames each."""
    top = _top(scored(spark, sf_dir), 16, "video_id").drop("rank")
    c = segments.gap_clusters(top, 10.0, t="ts")
    best = c.groupBy("video_id", "cluster").agg(F.max("score").alias("peak"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("peak"), F.desc("cluster")))).where("r <= 6")
    return _top(c.join(best.select("video_id", "cluster"), ["video_id", "cluster"]), 2, "video_id", "cluster").select("video_id", "cluster", "frame_index")


def fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the eight best by either of two scores, then greedily none within 15 s of a better one, ten at most."""
    s = scored(spark, sf_dir).withColumn("text_score", F.round(F.element_at("embedding", 1).cast("double"), 6))
    a = _top(s, 8, "video_id").select("video_id", "frame_index", "ts", F.col("score").alias("s"))
    b = _top(s, 8, "video_id", score="text_score").select("video_id", "frame_index", "ts", F.col("text_score").alias("s"))
    u = a.unionByName(b).groupBy("video_id", "ts").agg(F.max("s").alias("s"))
    ordered = u.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("neg"), "ts"))).alias("x"))
    return ordered.select("video_id", F.explode(segments.greedy_gap(F.transform("x", lambda y: y["ts"]), 15.0, 10)).alias("ts"))


def fuse_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose captions go with the fused ones: the eight best by text, and those shown."""
    s = scored(spark, sf_dir).withColumn("text_score", F.round(F.element_at("embedding", 1).cast("double"), 6))
    text = _top(s, 8, "video_id", score="text_score").select("video_id", "ts")
    return text.unionByName(fuse_dedup(spark, sf_dir)).distinct()


def scene_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best scenes of 16 frames by mean similarity, three frames of each by marginal relevance, in time order."""
    s = scored(spark, sf_dir).withColumn("scene", F.floor(F.col("frame_index") / 16).cast("long"))
    mean = s.groupBy("video_id", "scene").agg(F.round(F.avg("score"), 9).alias("mean"))
    best = mean.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("mean"), "scene"))).where("r <= 3")
    inside = s.join(best.select("video_id", "scene"), ["video_id", "scene"]).select("video_id", "scene", "frame_index", "embedding", F.col("score").alias("relevance"))
    picked = selection.mmr(inside, 3, 0.6, "video_id long, scene long, frame_index long, pick long", "video_id", "scene")
    return picked.select("video_id", "scene", "frame_index").orderBy("video_id", "frame_index")


def stated_interval_skeleton(spark: SparkSession, sf_dir: str, k: int = 16) -> DataFrame:
    """A share of the budget inside a stated interval (half; a quarter of a wide one), the rest adaptive keyframes; the interval's win.

    Odd videos state a narrow interval, even ones one of more than 300 seconds.
    """
    s = scored(spark, sf_dir).withColumn("score", F.round(selection.minmax("score", "video_id"), 9))
    wide = F.col("video_id") % 2 == 0
    s = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("video_id"))).withColumn("want", F.when(wide, F.lit(k // 4)).otherwise(F.lit(k // 2)))
    at = sampling.range_indexes(F.col("n"), F.lit(2.0), F.lit(5.0), F.when(wide, 400.0).otherwise(15.0), F.col("want"))
    dense = sampling.take(s, at).select("video_id", "frame_index", F.lit("stated").alias("origin"))
    have = dense.groupBy("video_id").agg(F.greatest(F.lit(1).cast("long"), k - F.count(F.lit(1))).alias("rest"))
    sparse = selection.adaptive_keyframes(s.join(have, "video_id"), "rest").withColumn("origin", F.lit("skeleton"))
    return dense.unionByName(sparse.join(dense, ["video_id", "frame_index"], "left_anti").select("video_id", "frame_index", "origin"))


def nearest_to_midpoint(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy(F.abs(F.col("ts") - 7.3), "frame_index")
    return frames(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("video_id", "frame_index", "rank")


QUERIES = {f.__name__: f for f in (global_topk_single_query, hybrid_topk, aks_select_k, mmr_select, coarse_to_fine, fuse_dedup, fuse_captions, scene_top, stated_interval_skeleton, nearest_to_midpoint)}

_SCORED = FRAMES_SQL + ", s AS (SELECT f.video_id, f.frame_index, f.ts, f.vec_id, f.e, round(list_inner_product(f.e, q.e), 9) AS score FROM frames f JOIN frames q ON q.video_id = f.video_id AND q.frame_index = 0)"
_SCALED = _SCORED + ", sc AS (SELECT *, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 9) AS x, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY video_id))"


def _aks(k: int | str, src: str = "sc") -> str:
    """``aks``: the selection of ``src`` (``video_id, frame_index, x, n``), with ``k`` a number or a column of it."""
    return f"""tree(video_id, depth, lo, hi) AS (SELECT DISTINCT video_id, 0, 0::BIGINT, n FROM {src} UNION ALL
SELECT t.video_id, t.depth + 1, CASE WHEN side = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN side = 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM tree t, range(2) r(side) WHERE t.depth < 5 AND hi - lo >= 2),
src AS (SELECT video_id, frame_index, x, n, {k} AS kk FROM {src}),
mem AS (SELECT s.video_id, frame_index, x, n, kk, depth, lo, hi, row_number() OVER (PARTITION BY s.video_id, depth, lo ORDER BY x DESC, frame_index) AS r FROM src s JOIN tree t ON t.video_id = s.video_id AND frame_index >= lo AND frame_index < hi),
st AS (SELECT video_id, depth, lo, hi, round(avg(x) FILTER (WHERE r <= kk) - avg(x), 9) > 0.8 OR depth = 5 OR hi - lo < 2 AS leaf FROM mem GROUP BY 1, 2, 3, 4),
top AS (SELECT mem.* FROM mem JOIN st USING (video_id, depth, lo) WHERE leaf QUALIFY row_number() OVER (PARTITION BY video_id, frame_index ORDER BY depth) = 1),
taken AS (SELECT video_id, frame_index FROM top WHERE r <= floor(kk / pow(2, depth))),
rest AS (SELECT s.video_id, frame_index, kk, row_number() OVER (PARTITION BY s.video_id ORDER BY x DESC, frame_index) AS r FROM src s ANTI JOIN taken USING (video_id, frame_index)),
aks AS (SELECT * FROM taken UNION SELECT rest.video_id, frame_index FROM rest LEFT JOIN (SELECT video_id, count(*) AS have FROM taken GROUP BY 1) h USING (video_id) WHERE r <= kk - coalesce(have, 0) UNION SELECT video_id, frame_index FROM src WHERE n <= kk)"""


def _mmr(k: int, group: str, src: str) -> str:
    """``walk``: greedy picks of ``src`` (``frame_index, e, score``) in each group, one list a step."""
    keys = [g.strip() for g in group.split(",")]
    same = " AND ".join(f"f.{g} = w.{g}" for g in keys)
    own = ", ".join(f"w.{g}" for g in keys)
    return f"""walk({group}, step, picks, seen) AS (SELECT {group}, 1, [arg_min(frame_index, (-round(score, 12), frame_index))], [arg_min(e, (-round(score, 12), frame_index))] FROM {src} GROUP BY {group} UNION ALL
SELECT {own}, w.step + 1, list_append(any_value(w.picks), arg_min(f.frame_index, (-round(0.6 * f.score - 0.4 * list_max(list_transform(w.seen, lambda v: list_inner_product(f.e, v))), 12), f.frame_index))),
list_append(any_value(w.seen), arg_min(f.e, (-round(0.6 * f.score - 0.4 * list_max(list_transform(w.seen, lambda v: list_inner_product(f.e, v))), 12), f.frame_index)))
FROM walk w JOIN {src} f ON {same} AND NOT list_contains(w.picks, f.frame_index) WHERE w.step < {k} GROUP BY {own}, w.step),
picked AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY step DESC) = 1)"""


ORACLE = {
    "global_topk_single_query": f"WITH {FRAMES_SQL} SELECT f.vec_id, f.video_id, round(list_inner_product(f.e, q.e), 6) AS score FROM frames f, (SELECT e FROM frames ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, vec_id LIMIT 20",
    "hybrid_topk": f"""WITH {_SCORED}, m AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-6 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS sim, greatest(0.0, 2.0 - ts, ts - 4.0)::DOUBLE AS o1, greatest(0.0, 10.0 - ts, ts - 11.0)::DOUBLE AS o2 FROM s WINDOW w AS (PARTITION BY video_id)),
x AS (SELECT video_id, frame_index, round(0.6 * greatest(CASE WHEN o1 = 0 THEN 1.0::DOUBLE WHEN o1 <= 5 THEN 0.5 * (1 - o1 / 6) ELSE 0 END, CASE WHEN o2 = 0 THEN 1.0::DOUBLE WHEN o2 <= 5 THEN 0.5 * (1 - o2 / 6) ELSE 0 END) + 0.4 * sim, 6) AS mixed FROM m)
SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY mixed DESC, frame_index) AS INT) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY mixed DESC, frame_index) <= 8""",
    "aks_select_k": f"WITH RECURSIVE {_SCALED}, {_aks(16)} SELECT * FROM aks",
    "coarse_to_fine": f"""WITH {_SCORED}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 16),
c0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY video_id ORDER BY ts, frame_index) > 10.0 THEN 1 ELSE 0 END AS fresh FROM t), c AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY video_id ORDER BY ts, frame_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM c0),
b AS (SELECT video_id, cluster, max(score) AS peak FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY max(score) DESC, cluster DESC) <= 6)
SELECT c.video_id, c.cluster, c.frame_index FROM c JOIN b USING (video_id, cluster) QUALIFY row_number() OVER (PARTITION BY c.video_id, c.cluster ORDER BY score DESC, frame_index) <= 2""",
    "fuse_dedup": f"""WITH RECURSIVE {_SCORED}, z AS (SELECT *, round(e[1], 6) AS text_score FROM s), u0 AS (SELECT video_id, ts, score AS v FROM z QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 8 UNION ALL SELECT video_id, ts, v FROM (SELECT video_id, ts, text_score AS v, row_number() OVER (PARTITION BY video_id ORDER BY text_score DESC, frame_index) AS r FROM z) WHERE r <= 8),
u AS (SELECT video_id, CAST(ts AS DOUBLE) AS ts, max(v) AS v FROM u0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY v DESC, ts) AS r FROM u),
walk(video_id, r, kept) AS (SELECT video_id, 1::BIGINT, [ts] FROM o WHERE r = 1 UNION ALL SELECT o.video_id, o.r, CASE WHEN len(kept) < 10 AND len(list_filter(kept, lambda k: abs(k - o.ts) < 15.0)) = 0 THEN list_append(kept, o.ts) ELSE kept END FROM walk w JOIN o ON o.video_id = w.video_id AND o.r = w.r + 1),
l AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY r DESC) = 1) SELECT video_id, unnest(kept) AS ts FROM l""",
    "mmr_select": f"WITH RECURSIVE {_SCORED}, {_mmr(6, 'video_id', 's')} SELECT video_id, unnest(picks) AS frame_index, unnest(range(1, len(picks) + 1)) AS pick FROM picked",
    "scene_top": f"""WITH RECURSIVE {_SCORED}, m AS (SELECT *, frame_index // 16 AS scene FROM s), b AS (SELECT video_id, scene FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(avg(score), 9) DESC, scene) <= 3),
i AS (SELECT m.* FROM m JOIN b USING (video_id, scene)), {_mmr(3, 'video_id, scene', 'i')} SELECT video_id, scene, unnest(picks) AS frame_index FROM picked""",
    "stated_interval_skeleton": f"""WITH RECURSIVE {_SCALED}, v AS (SELECT DISTINCT video_id, n, CASE WHEN video_id % 2 = 0 THEN 4 ELSE 8 END AS want, least(10, n - 1) AS a, CASE WHEN video_id % 2 = 0 THEN least(800, n - 1) ELSE least(30, n - 1) END AS b FROM sc),
v2 AS (SELECT *, least(want, b - a + 1) AS kk FROM v), d AS (SELECT DISTINCT video_id, CASE WHEN kk = 1 THEN a ELSE CAST(round_even(a + CAST(i AS DOUBLE) * (b - a) / (kk - 1), 0) AS BIGINT) END AS frame_index FROM v2, range(8) r(i) WHERE i < kk),
h AS (SELECT video_id, greatest(1, 16 - count(*)) AS rest FROM d GROUP BY 1), sk AS (SELECT sc.*, h.rest FROM sc JOIN h USING (video_id)), {_aks('rest', 'sk')}
SELECT *, 'stated' AS origin FROM d UNION ALL SELECT *, 'skeleton' FROM aks ANTI JOIN d USING (video_id, frame_index)""",
    "nearest_to_midpoint": f"WITH {FRAMES_SQL} SELECT video_id, frame_index, CAST(row_number() OVER (PARTITION BY video_id ORDER BY abs(ts - 7.3), frame_index) AS INT) AS rank FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY abs(ts - 7.3), frame_index) <= 4",
}
ORACLE["fuse_captions"] = ORACLE["fuse_dedup"].replace("SELECT video_id, unnest(kept) AS ts FROM l", "SELECT video_id, unnest(kept) AS ts FROM l UNION SELECT video_id, CAST(ts AS DOUBLE) FROM (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY text_score DESC, frame_index) <= 8)")
