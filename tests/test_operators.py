"""Operators at their edges: caps that fail, intervals, folds, streams over folders, parsers of odd replies."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import replies
from tempora.functions import text as tx
from tempora.operators import intervals, sampling, segments, selection
from tempora.plans import programs, streams
from tempora.streaming import runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_a_request_over_the_cap_fails(spark):
    df = spark.createDataFrame([(1, 3), (2, 9)], "request int, frames long")
    assert sampling.hard_cap(df, 9).count() == 2
    with pytest.raises(Exception, match="9 frames, 8 at most"):
        sampling.hard_cap(df, 8).collect()


def test_a_manifest_must_be_in_the_pool(spark):
    pool = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    manifest = spark.createDataFrame([(2, 0), (1, 1)], "id long, at int")
    assert [r.id for r in sampling.pinned(manifest, pool, "id", "at").collect()] == [2, 1]
    with pytest.raises(Exception, match="not in the pool: 3"):
        sampling.pinned(manifest.union(spark.createDataFrame([(3, 2)], manifest.schema)), pool, "id", "at").collect()


def test_linspace_rounds_halves_to_even(spark):
    assert one(spark, sampling.linspace_indexes(F.lit(10), F.lit(3))) == [0, 4, 9]
    assert one(spark, sampling.linspace_indexes(F.lit(2), F.lit(5))) == [0, 1]
    assert one(spark, sampling.linspace_indexes(F.lit(0), F.lit(5))) == []


def test_points_inside_intervals(spark):
    rnd = random.Random(1)
    points = [(v, i, float(rnd.randrange(40))) for v in (1, 2, 3) for i in range(30)]
    spans = [(rnd.choice((1, 2)), float(a := rnd.randrange(40)), float(a + rnd.randrange(6))) for _ in range(9)]
    p = spark.createDataFrame(points, "video_id long, i long, t double")
    s = spark.createDataFrame(spans, "video_id long, lo double, hi double")
    want = {x for x in points if any(v == x[0] and lo <= x[2] <= hi for v, lo, hi in spans)}
    assert {tuple(r) for r in intervals.inside(p, s, "left_semi").collect()} == want
    assert {tuple(r) for r in intervals.inside(p, s, "left_anti").collect()} == set(points) - want


def test_cuts(spark):
    rows = [(v, i, i in (2, 3, 4, 9)) for v in ("a", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "video_id string, frame_index long, wanted boolean")
    got = {(r.video_id, r.frame_index): r.segment for r in segments.cut_when(df, "wanted", 3, 8).collect()}
    segment = length = 0
    for i in range(20):
        if length >= 8 or (length >= 3 and i in (2, 3, 4, 9)):
            segment, length = segment + 1, 0
        length += 1
        assert got["a", i] == got["b", i] == segment


def recursive_keyframes(scores, k, depth=0, lo=0, hi=None):
    hi = len(scores) if hi is None else hi
    best = sorted(range(lo, hi), key=lambda i: (-scores[i], i))
    peak = sum(scores[i] for i in best[:k]) / min(k, hi - lo)
    if depth == selection.DEPTH or hi - lo < 2 or round(peak - sum(scores[lo:hi]) / (hi - lo), 9) > selection.SPREAD:
        return best[: k // 2**depth]
    mid = lo + (hi - lo) // 2
    return recursive_keyframes(scores, k, depth + 1, lo, mid) + recursive_keyframes(scores, k, depth + 1, mid, hi)


def test_keyframes_agree_with_the_recursion(spark):
    rnd = random.Random(2)
    videos = {v: [round(rnd.random() ** rnd.choice([1, 9, 40]), 3) for _ in range(rnd.choice([1, 5, 17, 90]))] for v in range(30)}
    df = spark.createDataFrame([(v, i, x, 3 + v % 9) for v, s in videos.items() for i, x in enumerate(s)], "video_id int, frame_index long, score double, k int")
    got = {v: set() for v in videos}
    for r in selection.adaptive_keyframes(df, "k").collect():
        got[r.video_id].add(r.frame_index)
    for v, scores in videos.items():
        k = 3 + v % 9
        taken = set(range(len(scores))) if len(scores) <= k else set(recursive_keyframes(scores, k))
        rest = sorted((i for i in range(len(scores)) if i not in taken), key=lambda i: (-scores[i], i))
        assert got[v] == taken | set(rest[: max(0, k - len(taken))]), v


def test_unknown_selectors_are_named(spark):
    assert programs.SELECTORS is selection.SELECTORS and "uniform" in selection.discover() and "uniform" not in selection.discover(("uniform",))
    with pytest.raises(KeyError, match="no selector nothing"):
        selection.load("nothing")


@pytest.mark.parametrize(
    ("question", "duration", "want"),
    [
        ("from 0:10-0:20 and 0:50", 100.0, [(10, 20), (50, 50)]),
        ("at 0:10 to 5:00?", 100.0, [(10, 10)]),
        ("1:00:05 until 1:00:09", 4000.0, [(3605, 3609)]),
        ("score 2:1, ratio 16:9:9:1", 4000.0, []),
        ("0:20 - 0:10", 100.0, [(20, 20), (10, 10)]),
        ("0:20", 0.0, []),
        ("nothing", 10.0, []),
    ],
)
def test_time_spans(spark, question, duration, want):
    assert [(s.lo, s.hi) for s in one(spark, replies.time_spans(F.lit(question), F.lit(duration)))] == want


def test_survey_clocks(spark):
    assert one(spark, tx.survey_times(F.lit("look at 1:05 and 2:10, again 1:05, 99:00"), F.lit(600.0))) == [65.0, 130.0]
    assert one(spark, tx.survey_times(F.lit("at 99:00"), F.lit(None).cast("double"))) == [5940.0]


@pytest.mark.parametrize(
    ("reply", "want"),
    [(None, "VisualRetrieve"), ("", "VisualRetrieve"), ("{}", "VisualRetrieve"), ('{"action": "stop"}', "Stop"), ("[1]", "VisualRetrieve"), ('{"action": "Inspect", "t0": null}', "VisualInspect"), ("{broken inspect 3", "VisualInspect")],
)
def test_planner_replies(spark, reply, want):
    got = one(spark, replies.planner_action(F.lit(reply).cast("string")))
    assert got.action == want and (got.top_k == 4) == (want == "VisualRetrieve")


def test_objects_and_channels(spark):
    texts = spark.createDataFrame([('a {x {"a": {"b": 1}} }',), ("{",), (None,)], "t string")
    assert [r[0] for r in texts.select(replies.first_object("t")).collect()] == ['{"a": {"b": 1}}', None, None]
    assert one(spark, replies.final_channel(F.lit("<|channel|>final<|message|>yes"))) == "yes"


def test_streams_read_folders_and_empty_tables(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for query in (streams.stream_tumbling, streams.stream_sessions):
        same = [sorted(map(tuple, query(spark, d).collect())) for d in (sf_dir, str(tmp_path))]
        assert same[0] == same[1] != []
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert streams.stream_tumbling(spark, f"{tmp_path}/none").count() == 0


def test_online_state_is_kept_between_batches(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "a", 9.0), (2, "b", 1.0), (3, "b", 5.0)], "batch int, key string, value double")
    told = {(r.batch, r.key, r.value): r.predicted for r in runs.online(df, "batch", "key", "value").collect()}
    assert told == {(1, "a", 2.0): None, (1, "a", 4.0): None, (2, "a", 9.0): 3.0, (2, "b", 1.0): None, (3, "b", 5.0): 1.0}
