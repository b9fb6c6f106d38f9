"""Loose replies, questions and settings taken apart, each built from an event's own values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import replies
from tempora.functions import text as tx
from tempora.sources.tables import captions, table

OPTIONS = ("A. red", "B. blue", "C. green", "D. yellow")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number ``k`` of their properties."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _by_type(**forms: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, form in forms.items():
        out = F.when(F.col("event_type") == name, form).otherwise(out)
    return out


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("long").cast("string")), ",")


def survey_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks that a reply names: distinct, in order, none beyond an hour."""
    e = _events(spark, sf_dir)
    a, b = F.col("k") * 53 + F.floor("value").cast("long"), F.col("k") * 97
    long = F.format_string("%d:%02d:%02d", F.floor(b / 3600).cast("long"), F.floor(b % 3600 / 60).cast("long"), b % 60)
    reply = _text("Look at ", tx.clock(a), " and 7 more, then ", long, ", again ", tx.clock(a), ".")
    return e.select("event_id", _joined(tx.survey_times(reply, F.lit(3600.0))).alias("times"))


def time_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and instants that a question names by clocks."""
    e = _events(spark, sf_dir)
    a = F.col("k") * 45
    joiner = _by_type(view=F.lit("-"), click=F.lit(" to "), error=F.lit(" and "), purchase=F.lit(" until "), signup=F.lit(", "))
    question = _text("Compare ", tx.clock(a), joiner, tx.clock(a + 90), " with ", tx.clock(F.abs(a - 600)), " at 2:1.")
    spans = replies.time_spans(question, F.lit(4000.0))
    shown = F.transform(spans, lambda s: F.concat(s["lo"].cast("long").cast("string"), F.lit("-"), s["hi"].cast("long").cast("string")))
    return e.select("event_id", F.array_join(shown, ";").alias("spans"))


def span_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    lo = F.col("k") * 37.0 + 0.5
    return e.select("event_id", replies.span_clock(lo, lo + F.when(F.col("k") % 3 == 0, 0.25).otherwise(61.0)).alias("span"))


def reply_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and events that a reply names, of 30 frames and 9 events."""
    k = F.col("k")
    frames = _by_type(
        view=_text('{"relevant_indices": [', k, ", 3, ", k + 3, ', "x"]}'),
        click=_text("see [", k, "] and [", k % 30, "], also [12][1][2][3][4][5][6][7]"),
        error=_text('{"relevant_indices": "', k % 40, ', 5"}'),
        purchase=F.lit("none at all"),
        signup=_text('broken {"relevant_indices": "', k, ' or 8'),
    )
    events = _by_type(
        view=_text('{"relevant_events": [', k % 12, ", 2]}"),
        click=_text("Event ", k % 12, " then Event 4, Event 0, Event3, Event 5, Event 6, Event 7"),
        error=_text('{"relevant_events": "', k % 12, '"}'),
        purchase=F.lit("nothing"),
        signup=F.lit("Events"),
    )
    return _events(spark, sf_dir).select("event_id", _joined(replies.frame_indexes(frames, F.lit(30))).alias("frames"), _joined(replies.event_indexes(events, F.lit(9))).alias("events"))


def planner_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planner's reply as an action and its arguments."""
    k = F.col("k")
    reply = _by_type(
        view=_text('Plan: {"action": "VisualRetrieve", "query": "red car ', k, '", "top_k": ', k % 7, "}"),
        click=_text('{"action": "visualinspect", "t0": ', k, ', "t1": ', k % 3 * 5, "}"),
        error=_text("I would inspect ", k, " to ", k + 9, " seconds"),
        purchase=F.when(k % 2 == 0, '{"action": "Stop"}').otherwise("please stop"),
        signup=F.when(k % 2 == 0, '{"action": "Find"}').otherwise("look for it"),
    )
    return _events(spark, sf_dir).select("event_id", replies.planner_action(reply).alias("x")).select("event_id", "x.*")


def inspect_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inspector's reply as a verdict."""
    k = F.col("k")
    letter = F.char(k % 6 + 65)
    reply = _by_type(
        view=_text('{"sufficient": ', k % 2, ', "feedback": " seen ', k, ' ", "final_answer": "', letter, '"}'),
        click=_text('{"sufficient": "true", "final_answer": "(', letter, ')"}'),
        error=_text("The answer is ", letter),
        purchase=F.lit("nothing to see"),
        signup=_text('{"sufficient": false, "feedback": "no"}'),
    )
    options = F.array(*[F.lit(o) for o in OPTIONS])
    return _events(spark, sf_dir).select("event_id", replies.inspection(reply, options).alias("x")).select("event_id", "x.*")


def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced blocks of a report with their names, broken ones left out, and the first object of loose text."""
    k = F.col("k")
    text = _text("Done.\n**`logs/p", k, '.json`**:\n```json\n{"k": ', k, "}\n```\nand\n```json\n{broken ", k, "\n```\nthen\n```json\n[1, ", k, "]\n```")
    b = _events(spark, sf_dir).select("event_id", F.posexplode(replies.json_blocks(text)).alias("at", "x"), replies.first_object(_text("so {a} then ", '{"x": {"y": ', k, "}} end")).alias("object"))
    return b.select("event_id", "at", "x.name", "x.body", "object")


def range_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a reply with a JSON field, and of one where it cannot be read."""
    k = F.col("k")
    reply = F.when(k % 2 == 0, _text('{"ranges": [[', k % 70, ", ", k % 50, "], [1, 2], [3], [5, 99]]}")).otherwise(_text('{"ranges": oops [', k % 70, "-", k, "]"))
    e = _events(spark, sf_dir)
    return e.select("event_id", F.posexplode(tx.ranges(reply, F.lit(60))).alias("at", "x")).select("event_id", "at", "x.lo", "x.hi")


def env_truthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    setting = _by_type(view=F.lit("1"), click=F.lit(" False "), error=F.lit(""), purchase=F.when(F.col("k") % 2 == 0, "off").otherwise("yes"))
    return _events(spark, sf_dir).select("event_id", replies.truthy(setting).alias("enabled"))


def final_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    thought = _text("<|channel|>analysis<|message|>thinking ", k, "<|end|>")
    reply = F.when(k % 3 == 0, _text(thought, "<|start|>assistant<|channel|>final<|message|>answer ", k, "<|return|>")).when(k % 3 == 1, thought).otherwise(_text("plain ", k))
    return _events(spark, sf_dir).select("event_id", replies.final_channel(reply).alias("message"))


def question_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without the options below them."""
    b = table(spark, sf_dir, "benchmark")
    asked = F.concat(F.col("text"), F.lit("\n(A) one\n(B) two"))
    return b.select("item_id", replies.question_stem(asked).alias("stem"), tx.squeeze(F.left("text", F.lit(40))).alias("key"))


def scene_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four turns of each conversation as a scene's summary."""
    c = captions(spark, sf_dir)
    g = c.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", F.left("caption", F.lit(30)).alias("s")))).alias("x"))
    return g.select("video_id", F.md5(replies.scene_summary(F.transform("x", lambda y: y["s"]))).alias("summary_md5"))


QUERIES = {f.__name__: f for f in (survey_times, time_spans, span_clocks, reply_indexes, planner_actions, inspect_replies, json_blocks, range_replies, env_truthiness, final_channel, question_stems, scene_summaries)}

_E = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_CLOCK = "(CAST({x} AS BIGINT) // 60) || ':' || lpad(CAST(CAST({x} AS BIGINT) % 60 AS VARCHAR), 2, '0')"
_SECONDS = "list_transform({x}, lambda c: list_reduce(list_transform(string_split(c, ':'), lambda y: CAST(y AS BIGINT)), lambda a, b: a * 60 + b))"
ORACLE = {
    "survey_times": f"""WITH {_E}, a AS (SELECT event_id, k * 53 + CAST(floor(value) AS BIGINT) AS a, k * 97 AS b FROM e),
r AS (SELECT event_id, 'Look at ' || {_CLOCK.format(x='a')} || ' and 7 more, then ' || printf('%d:%02d:%02d', b // 3600, b % 3600 // 60, b % 60) || ', again ' || {_CLOCK.format(x='a')} || '.' AS reply FROM a),
t AS (SELECT event_id, list_filter({_SECONDS.format(x="regexp_extract_all(reply, '[0-9]{1,2}:[0-5][0-9](?::[0-5][0-9])?')")}, lambda s: s <= 3600) AS l FROM r)
SELECT event_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS times FROM t""",
    "time_spans": f"""WITH {_E}, a AS (SELECT event_id, event_type, k * 45 AS a FROM e), p AS (SELECT event_id, event_type IN ('view', 'click', 'purchase') AND a + 90 <= 4000 AS joined, a, a + 90 AS b, abs(a - 600) AS c FROM a),
u AS (SELECT event_id, list_concat(CASE WHEN a > 4000 THEN [] WHEN joined THEN [a || '-' || b] ELSE [a || '-' || a] END, CASE WHEN b <= 4000 AND NOT (joined AND a <= 4000) THEN [b || '-' || b] ELSE [] END, CASE WHEN c <= 4000 THEN [c || '-' || c] ELSE [] END) AS l FROM p)
SELECT event_id, array_to_string(l, ';') AS spans FROM u""",
    "span_clocks": f"""WITH {_E}, s AS (SELECT event_id, k, CAST(round_even(k * 37.0 + 0.5, 0) AS BIGINT) AS a, CAST(round_even(k * 37.0 + 61.5, 0) AS BIGINT) AS b FROM e)
SELECT event_id, CASE WHEN k % 3 = 0 THEN {_CLOCK.format(x='a')} || ' (=' || a || 's)' ELSE {_CLOCK.format(x='a')} || '-' || {_CLOCK.format(x='b')} || ' (=' || a || 's-' || b || 's)' END AS span FROM s""",
    "reply_indexes": f"""WITH {_E}, x AS (SELECT event_id, CASE event_type WHEN 'view' THEN [k, 3, k + 3] WHEN 'click' THEN CASE WHEN k < 30 THEN [k, k % 30, 12, 1, 2, 3, 4, 5] ELSE [k % 30, 12, 1, 2, 3, 4, 5, 6] END WHEN 'error' THEN [k % 40, 5] ELSE [] END AS f,
CASE event_type WHEN 'view' THEN list_filter([k % 12, 2], lambda i: i BETWEEN 1 AND 9) WHEN 'click' THEN list_filter([k % 12, 4, 0, 3, 5, 6, 7], lambda i: i BETWEEN 1 AND 9)[1:4] WHEN 'error' THEN list_filter([k % 12], lambda i: i BETWEEN 1 AND 9) ELSE [] END AS v FROM e)
SELECT event_id, array_to_string(list_filter(f, lambda i: i < 30), ',') AS frames, array_to_string(list_transform(v, lambda i: i - 1), ',') AS events FROM x""",
    "planner_actions": f"""WITH {_E} SELECT event_id, CASE event_type WHEN 'view' THEN 'VisualRetrieve' WHEN 'click' THEN 'VisualInspect' WHEN 'error' THEN 'VisualInspect' WHEN 'purchase' THEN 'Stop' ELSE 'VisualRetrieve' END AS action,
CASE event_type WHEN 'view' THEN 'red car ' || k WHEN 'signup' THEN 'key evidence' END AS query, CAST(CASE event_type WHEN 'view' THEN coalesce(nullif(k % 7, 0), 4) WHEN 'signup' THEN 4 END AS INT) AS top_k,
CAST(CASE WHEN event_type IN ('click', 'error') THEN k END AS DOUBLE) AS t0, CAST(CASE event_type WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN k + 16 ELSE k % 3 * 5 END WHEN 'error' THEN k + 9 END AS DOUBLE) AS t1 FROM e""",
    "inspect_replies": f"""WITH {_E}, l AS (SELECT *, CASE WHEN k % 6 < 4 THEN chr(CAST(k % 6 + 65 AS INT)) ELSE '' END AS letter FROM e)
SELECT event_id, CAST(CASE event_type WHEN 'view' THEN k % 2 WHEN 'click' THEN 1 ELSE 0 END AS INT) AS sufficient, CASE event_type WHEN 'view' THEN 'seen ' || k WHEN 'click' THEN '{{"sufficient": "true", "final_answer": "(' || chr(CAST(k % 6 + 65 AS INT)) || ')"}}' WHEN 'error' THEN 'The answer is ' || chr(CAST(k % 6 + 65 AS INT)) WHEN 'purchase' THEN 'nothing to see' ELSE 'no' END AS feedback,
CASE WHEN event_type IN ('view', 'click', 'error') THEN letter ELSE '' END AS final_answer FROM l""",
    "json_blocks": f"""WITH {_E}, t AS (SELECT event_id, k, 'Done.' || chr(10) || '**`logs/p' || k || '.json`**:' || chr(10) || '```json' || chr(10) || '{{"k": ' || k || '}}' || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```json' || chr(10) || '{{broken ' || k || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```json' || chr(10) || '[1, ' || k || ']' || chr(10) || '```' AS x FROM e),
b AS (SELECT event_id, k, unnest(list_filter(list_transform(regexp_extract_all(x, '```json\\s*\\n([^`]*)```', 1), lambda y: trim(y, chr(10) || ' ')), lambda y: json_valid(y))) AS body FROM t)
SELECT event_id, CAST(CASE WHEN body LIKE '[%' THEN 1 ELSE 0 END AS INT) AS "at", CASE WHEN body NOT LIKE '[%' THEN 'p' || k || '.json' END AS name, body, '{{"x": {{"y": ' || k || '}}}}' AS object FROM b""",
    "range_replies": f"""WITH {_E} SELECT event_id, CAST(0 AS INT) AS "at", least(k % 70, 59) AS lo, greatest(least(k % 70, 59), least(k % 50, 59)) AS hi FROM e WHERE k % 2 = 0 UNION ALL SELECT event_id, 1, 1, 2 FROM e WHERE k % 2 = 0 UNION ALL SELECT event_id, 2, 5, 59 FROM e WHERE k % 2 = 0
UNION ALL SELECT event_id, 0, least(k % 70, 59), greatest(least(k % 70, 59), least(k, 59)) FROM e WHERE k % 2 = 1""",
    "env_truthiness": f"WITH {_E}, s AS (SELECT event_id, CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN ' False ' WHEN 'error' THEN '' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'off' ELSE 'yes' END END AS s FROM e) SELECT event_id, s IS NULL OR trim(s) = '' OR NOT regexp_full_match(lower(trim(s)), '0|false|no|off') AS enabled FROM s",
    "final_channel": f"WITH {_E} SELECT event_id, CASE k % 3 WHEN 0 THEN 'answer ' || k WHEN 1 THEN 'thinking ' || k ELSE 'plain ' || k END AS message FROM e",
    "question_stems": "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS stem, regexp_replace(lower(trim(left(text, 40))), '\\s+', ' ', 'g') AS key FROM benchmark",
    "scene_summaries": "WITH g AS (SELECT conv_id AS video_id, list(left(text, 30) ORDER BY turn, left(text, 30)) AS x FROM conversations GROUP BY 1) SELECT video_id, md5(array_to_string(x[1:4], ' | ')) AS summary_md5 FROM g",
}
