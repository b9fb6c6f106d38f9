"""Selection programs over generated needle videos, answered by a stub model and scored.

A video has one frame with a hint of its answer; the stub model reads the hint
only if that frame is selected, so a program's accuracy measures its selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.operators import sampling, segments, selection
from tempora.operators.selection import SELECTORS, register
from tempora.plans.selection import _aks
from tempora.sources.tables import captions

VIDEOS, FRAMES, BUDGET = 200, 60, 8
COLOURS = ("red", "blue", "green", "yellow")


def needle_videos(spark: SparkSession, videos: int = VIDEOS, frames: int = FRAMES) -> DataFrame:
    """``video_id, frame_index, t, n, caption, answer, score``: generated by arithmetic, so repeatable anywhere."""
    v = spark.range(videos).select(F.col("id").alias("video_id"), ((F.col("id") * 37 + 11) % frames).alias("needle"), ((F.col("id") * 7 + 3) % 4).cast("int").alias("ans"))
    f = v.withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))))
    colours = F.array(*[F.lit(c) for c in COLOURS])
    is_needle = F.col("frame_index") == F.col("needle")
    colour = F.when(is_needle, F.col("ans")).otherwise((F.col("ans") + 1 + F.col("frame_index") % 3) % 4).cast("int")
    answer = F.char(F.col("ans") + 65)
    caption = F.concat(F.lit("a "), F.element_at(colours, colour + 1), F.lit(" sign"), F.when(is_needle, F.concat(F.lit("  ANSWER_HINT: "), answer)).otherwise(""))
    noise = (F.col("frame_index") * 29 + F.col("video_id") * 13) % 101 / 101.0
    score = F.round(noise * 0.8 + F.when(is_needle, F.col("video_id") % 5 / 5.0).otherwise(0.0), 6)
    return f.select("video_id", "frame_index", (F.col("frame_index") * 2.0).alias("t"), F.lit(frames).cast("long").alias("n"), caption.alias("caption"), answer.alias("answer"), score.alias("score"))


def stub_answer(context: Column) -> Column:
    """The letter that the context hints at, first hint first; A without one."""
    return F.coalesce(F.upper(F.nullif(F.regexp_extract(context, r"ANSWER_HINT:\s*([A-Za-z])", 1), F.lit(""))), F.lit("A"))


def _best(f: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy(F.desc("score"), "frame_index")
    return f.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("video_id", "frame_index")


def _uniform(f: DataFrame, k: int) -> DataFrame:
    return sampling.take(f, sampling.uniform_indexes(F.col("n"), F.lit(k))).select("video_id", "frame_index")


def _stride(f: DataFrame, k: int) -> DataFrame:
    return sampling.stride(f, k).select("video_id", "frame_index")


def _first(f: DataFrame, k: int) -> DataFrame:
    return f.where(F.col("frame_index") < k).select("video_id", "frame_index")


def _keyframes(f: DataFrame, k: int) -> DataFrame:
    return selection.adaptive_keyframes(f.withColumn("score", F.round(selection.minmax("score", "video_id"), 9)), k)


def _coarse(f: DataFrame, k: int) -> DataFrame:
    top = f.join(_best(f, 2 * k), ["video_id", "frame_index"])
    c = segments.gap_clusters(top, 6.0)
    order = Window.partitionBy("video_id", "cluster").orderBy(F.desc("score"), "frame_index")
    lead = c.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return _best(lead, k)


def _timeline(f: DataFrame, k: int) -> DataFrame:
    return f.where("frame_index % 10 = 0").select("video_id", "frame_index").union(_best(f, max(1, k - 6))).distinct()


def _focus(f: DataFrame, k: int) -> DataFrame:
    w = segments.best_window(f, F.lit(k // 2).cast("long"), "score")
    inside = f.join(w, "video_id").where("frame_index >= start AND frame_index < start + width").select("video_id", "frame_index")
    return inside.union(_uniform(f, k - k // 2)).distinct()


def _scenes(f: DataFrame, k: int) -> DataFrame:
    s = f.withColumn("scene", F.floor(F.col("frame_index") / 16).cast("long"))
    order = Window.partitionBy("video_id", "scene").orderBy(F.desc("score"), "frame_index")
    return s.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(1, k // 4)).select("video_id", "frame_index")


def _hybrid(f: DataFrame, k: int) -> DataFrame:
    return _uniform(f, k // 2).union(_best(f, k - k // 2)).distinct()


for _name, _selector in {"uniform": _uniform, "stride": _stride, "first": _first, "retrieved": _best, "keyframes": _keyframes, "coarse_to_fine": _coarse, "timeline": _timeline, "focus": _focus, "scenes": _scenes, "hybrid": _hybrid}.items():
    register(_name, _selector)


def needle_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered program's accuracy and frames shown on the needle videos."""
    f = needle_videos(spark)
    out = None
    for name, selector in sorted(SELECTORS.items()):
        shown = f.join(selector(f, BUDGET), ["video_id", "frame_index"], "left_semi")
        g = shown.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "caption"))), lambda x: x["caption"]), "\n").alias("context"), F.first("answer").alias("answer"), F.count(F.lit(1)).alias("frames"))
        one = g.select(F.lit(name).alias("program"), (stub_answer(F.col("context")) == F.col("answer")).alias("ok"), "frames")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("program").agg(F.count(F.lit(1)).alias("videos"), F.sum(F.col("ok").cast("long")).alias("correct"), F.sum("frames").alias("frames"))


def needle_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniform program alone, video by video."""
    f = needle_videos(spark)
    shown = f.join(_uniform(f, BUDGET), ["video_id", "frame_index"], "left_semi")
    g = shown.groupBy("video_id").agg(F.max(F.nullif(F.regexp_extract("caption", r"ANSWER_HINT:\s*([A-Z])", 1), F.lit(""))).alias("hint"), F.first("answer").alias("answer"))
    return g.select("video_id", F.coalesce("hint", F.lit("A")).alias("predicted"), "answer")


def needle_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program with a memory of its own: every second frame is kept, the best of them are shown, videos without frames cannot be told."""
    f = needle_videos(spark).where("video_id % 10 <> 9")
    questions = spark.range(VIDEOS).withColumnRenamed("id", "video_id")
    return selection.run_program(f, questions, lambda x: x.where("frame_index % 2 = 0"), selection.load("retrieved"), stub_answer, BUDGET)


MOCK = "video_id string, duration double, fps double, frames array<struct<t: int, caption: string, hint: string, size: array<int>>>"


def decode(videos: DataFrame) -> DataFrame:
    """Frames of videos given as text (``video``): a JSON document is a mock video, anything else a path.

    A hint joins its frame's caption. A path gives one row without frames, for a decoder to fill.
    """
    v = videos.select("*", F.from_json("video", MOCK).alias("_v"))
    is_mock = F.coalesce(F.size("_v.frames") > 0, F.lit(False))
    mock = v.where(is_mock).select(F.col("_v.video_id").alias("video_id"), F.lit("mock").alias("source"), F.posexplode("_v.frames").alias("frame_index", "f"))
    caption = F.concat(F.coalesce("f.caption", F.lit("")), F.coalesce(F.concat(F.lit("  ANSWER_HINT: "), F.col("f.hint")), F.lit("")))
    size = F.coalesce("f.size", F.array(F.lit(224), F.lit(224)))
    mock = mock.select("video_id", "source", "frame_index", F.col("f.t").cast("double").alias("t"), caption.alias("caption"), size[0].alias("width"), size[1].alias("height"))
    path = v.where(~is_mock).select(F.col("video").alias("video_id"), F.lit("path").alias("source"), *[F.lit(None).cast(k).alias(c) for c, k in (("frame_index", "int"), ("t", "double"), ("caption", "string"), ("width", "int"), ("height", "int"))])
    return mock.unionByName(path)


def mock_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mock videos in JSON, taken apart again, beside paths; every frame at the stride of its rate."""
    c = captions(spark, sf_dir)
    frame = F.struct("frame_index", F.struct((F.col("frame_index") * 2).cast("int").alias("t"), F.left("caption", F.lit(20)).alias("caption"), F.when(F.col("frame_index") == F.col("video_id") % 5, "B").alias("hint"), F.when(F.col("frame_index") % 2 == 1, F.array(F.lit(320), F.lit(240))).alias("size")).alias("f"))
    g = c.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(frame)), lambda x: x["f"]).alias("frames"))
    doc = F.to_json(F.struct(F.concat(F.lit("mock_"), F.col("video_id")).alias("video_id"), F.lit(16.0).alias("duration"), F.lit(2.0).alias("fps"), "frames"))
    videos = g.select(F.when(F.col("video_id") % 4 == 0, F.concat(F.lit("/videos/"), F.col("video_id"), F.lit(".mp4"))).otherwise(doc).alias("video"))
    stride = 2  # max(1, int(fps))
    return decode(videos).where((F.col("source") == "path") | (F.col("frame_index") % stride == 0))


QUERIES = {f.__name__: f for f in (needle_accuracy, needle_uniform, needle_memory, mock_decode)}
_NEEDLES = """v AS (SELECT v AS video_id, (v * 37 + 11) % 60 AS needle, (v * 7 + 3) % 4 AS ans FROM range(200) r(v)), f AS (SELECT video_id, i AS frame_index, i * 2.0::DOUBLE AS t, 60::BIGINT AS n, i = needle AS hit, ans,
round(((i * 29 + video_id * 13) % 101 / 101.0::DOUBLE) * 0.8::DOUBLE + CASE WHEN i = needle THEN video_id % 5 / 5.0::DOUBLE ELSE 0 END, 6) AS score FROM v, range(60) r(i)),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) AS r FROM f), nd AS (SELECT video_id, frame_index, n, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 9) AS x FROM f WINDOW w AS (PARTITION BY video_id))"""
_PICKS = """c0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t, frame_index) > 6 THEN 1 ELSE 0 END AS fresh FROM b WHERE r <= 16), c1 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY t, frame_index ROWS UNBOUNDED PRECEDING) AS cluster FROM c0), c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY video_id, cluster ORDER BY score DESC, frame_index) = 1),
w0 AS (SELECT video_id, frame_index AS start, count(*) OVER x AS m, round(sum(score) OVER x, 6) AS total FROM f WINDOW x AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)), w1 AS (SELECT * FROM w0 WHERE m = 4 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY total DESC, start) = 1),
picks AS (SELECT 'uniform' AS program, video_id, frame_index FROM f WHERE list_contains([0, 7, 15, 22, 30, 37, 45, 52], frame_index) UNION SELECT 'stride', video_id, frame_index FROM f WHERE frame_index % 7 = 0 AND frame_index // 7 < 8 UNION SELECT 'first', video_id, frame_index FROM f WHERE frame_index < 8
UNION SELECT 'retrieved', video_id, frame_index FROM b WHERE r <= 8 UNION SELECT 'keyframes', video_id, frame_index FROM aks UNION SELECT 'coarse_to_fine', video_id, frame_index FROM (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 8)
UNION SELECT 'timeline', video_id, frame_index FROM b WHERE frame_index % 10 = 0 OR r <= 2 UNION SELECT 'focus', f.video_id, frame_index FROM f JOIN w1 USING (video_id) WHERE frame_index BETWEEN start AND start + 3 OR frame_index % 15 = 0
UNION SELECT 'scenes', video_id, frame_index FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video_id, frame_index // 16 ORDER BY score DESC, frame_index) <= 2) UNION SELECT 'hybrid', video_id, frame_index FROM b WHERE frame_index % 15 = 0 OR r <= 4),
g AS (SELECT program, p.video_id, bool_or(hit) OR any_value(ans) = 0 AS ok, count(*) AS frames FROM picks p JOIN f USING (video_id, frame_index) GROUP BY 1, 2)"""
ORACLE = {
    "needle_accuracy": f"WITH RECURSIVE {_NEEDLES}, {_aks(8, 'nd')}, {_PICKS} SELECT program, count(*) AS videos, count(*) FILTER (WHERE ok) AS correct, CAST(sum(frames) AS BIGINT) AS frames FROM g GROUP BY 1",
    "needle_memory": f"""WITH {_NEEDLES}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) AS q FROM f WHERE frame_index % 2 = 0 AND video_id % 10 <> 9), g AS (SELECT video_id, bool_or(hit) AS hit, any_value(ans) AS ans, count(*) AS frames FROM k WHERE q <= 8 GROUP BY 1)
SELECT v.video_id, CASE WHEN g.video_id IS NULL THEN '?' WHEN hit THEN chr(CAST(65 + g.ans AS INT)) ELSE 'A' END AS prediction, coalesce(frames, 0) AS frames FROM v LEFT JOIN g USING (video_id)""",
    "mock_decode": """SELECT 'mock_' || conv_id AS video_id, 'mock' AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS frame_index, turn * 2.0::DOUBLE AS t, left(text, 20) || CASE WHEN turn = conv_id % 5 THEN '  ANSWER_HINT: B' ELSE '' END AS caption,
CAST(CASE WHEN turn % 2 = 1 THEN 320 ELSE 224 END AS INT) AS width, CAST(CASE WHEN turn % 2 = 1 THEN 240 ELSE 224 END AS INT) AS height FROM conversations WHERE conv_id % 4 <> 0 QUALIFY (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 = 0
UNION ALL SELECT DISTINCT '/videos/' || conv_id || '.mp4', 'path', CAST(NULL AS INT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST(NULL AS INT) FROM conversations WHERE conv_id % 4 = 0""",
    "needle_uniform": "SELECT v AS video_id, CASE WHEN list_contains([0, 7, 15, 22, 30, 37, 45, 52], (v * 37 + 11) % 60) THEN chr(CAST((v * 7 + 3) % 4 + 65 AS INT)) ELSE 'A' END AS predicted, chr(CAST((v * 7 + 3) % 4 + 65 AS INT)) AS answer FROM range(200) r(v)",
}
