"""Streaming and stateful queries, caches and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tempora.sources.tables import captions, table
from tempora.streaming import runs


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type, as a stream; the watermark lets days go, and days still open at the end are added."""
    def days(events: DataFrame) -> DataFrame:
        g = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")

    closed = runs.final_state(days(runs.event_stream(spark, sf_dir).withWatermark("ts", "1 day")))
    every = days(events_table(spark, sf_dir))
    whole = closed.unionByName(every.join(closed.select("start").distinct(), "start", "left_anti"))
    return whole.select(F.dayofmonth("start").alias("day"), "event_type", "n", "total")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a table, times without a zone taken as the session's."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that six hours without an event end, as a stream; sessions still open at the end are added."""
    def sessions(events: DataFrame) -> DataFrame:
        g = events.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least_event"))
        return g.select("user_id", "n", "least_event")

    closed = runs.final_state(sessions(runs.event_stream(spark, sf_dir).withWatermark("ts", "1 day")))
    every = sessions(events_table(spark, sf_dir))
    return closed.unionByName(every.join(closed.select("user_id", "least_event"), ["user_id", "least_event"], "left_anti"))


def online_state_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week is a batch: each value is predicted from the state that the weeks before have left in a table."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.floor(F.dayofmonth("ts") / 7).cast("int").alias("week"))
    p = runs.online(e, "week", "user_id", "value")
    return p.groupBy("week").agg(F.count("predicted").alias("predicted"), F.round(F.avg(F.abs(F.col("value") - F.col("predicted"))), 6).alias("error"))


def offline_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five epochs over labelled batches, judged on events kept apart after each, with an early stop."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    batches = [e.where((F.col("event_id") % 6 == i) & (F.col("event_id") % 7 != 0)) for i in range(5)]
    return runs.epochs(batches, e.where("event_id % 7 = 0"), "user_id", "value")


def online_prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is a batch: each value is predicted from the user's days before."""
    e = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    p = runs.prequential(e, "day", "user_id", "value")
    return p.groupBy("day").agg(F.count("predicted").alias("predicted"), F.round(F.avg(F.abs(F.col("value") - F.col("predicted"))), 6).alias("error"))


def response_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose key (a checksum of their parts) no earlier answer holds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("model"), "lang", "text"), 256).alias("key"))
    cache = d.where("doc_id % 3 = 0").select("key").distinct()
    return d.where("doc_id % 3 <> 0").join(cache, "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("first_request"), F.count(F.lit(1)).alias("requests"))


def tool_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls and the next assistant turn as their result; calls without one stay."""
    c = captions(spark, sf_dir)
    calls = c.where("role = 'user'").select("video_id", "frame_index", F.length("caption").alias("asked"))
    results = c.where("role = 'assistant'").select("video_id", (F.col("frame_index") - 1).alias("frame_index"), F.length("caption").alias("answered"))
    return calls.join(results, ["video_id", "frame_index"], "left").groupBy("video_id").agg(F.count(F.lit(1)).alias("calls"), F.count("answered").alias("answered"), F.sum("asked").alias("chars_in"), F.sum("answered").alias("chars_out"))


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files: views read, purchases overwrite, clicks edit; lines are the last write and the edits since."""
    e = table(spark, sf_dir, "events").withColumn("lines", F.get_json_object("props", "$.k").cast("long"))
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("lines", F.struct("ts", "event_id")).alias("written"), F.max(F.struct("ts", "event_id")).alias("at"))
    g = e.join(last, "user_id", "left").groupBy("user_id").agg(
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("reads"),
        F.coalesce(F.first("written"), F.lit(0)).alias("written"),
        F.sum(F.when((F.col("event_type") == "click") & (F.col("at").isNull() | (F.struct("ts", "event_id") > F.col("at"))), F.coalesce("lines", F.lit(0))).otherwise(0)).alias("edited"),
    )
    return g.select("user_id", "reads", (F.col("written") + F.col("edited")).alias("lines"))


def context_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: requests, parts without a source, errors, and whether the trace is complete."""
    c = captions(spark, sf_dir)
    g = c.groupBy("video_id").agg(F.collect_list(F.struct("frame_index", "role", F.length("caption").alias("chars"))).alias("parts"))
    requests = F.size(F.filter("parts", lambda p: p["role"] == "user"))
    loose = F.size(F.filter("parts", lambda p: p["chars"] < 20))
    return g.select("video_id", requests.alias("requests"), loose.alias("unattributed"), ((requests > 0) & (loose == 0)).alias("complete"))


_STOP = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("epoch", T.LongType()), T.StructField("at", T.LongType()), T.StructField("stopped", T.BooleanType())])


def early_stopping(spark: SparkSession, sf_dir: str, patience: int = 2) -> DataFrame:
    """A customer's orders as epochs: stop after two without a better score; the best epoch is restored."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_custkey").alias("customer")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("scores"))
    zero = F.struct(F.lit(-1.0).alias("best"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("stopped")).cast(_STOP)

    def step(a, x):
        better = ~a["stopped"] & (x > a["best"])
        at = a["at"] + F.when(a["stopped"], 0).otherwise(1)
        epoch = F.when(better, at).otherwise(a["epoch"])
        return F.struct(F.when(better, x).otherwise(a["best"]).alias("best"), epoch.alias("epoch"), at.alias("at"), (a["stopped"] | (at - epoch >= patience)).alias("stopped")).cast(_STOP)

    return g.select("customer", F.aggregate("scores", zero, step).alias("x")).select("customer", F.col("x.epoch").alias("best_epoch"), F.col("x.at").alias("epochs"), F.col("x.best").alias("score"))


def completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that arrive in order of value, put back in the order they were asked for."""
    e = table(spark, sf_dir, "events")
    arrived = Window.partitionBy("user_id").orderBy("value", "event_id")
    asked = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("user_id", "event_id", F.row_number().over(arrived).alias("arrived"), F.row_number().over(asked).alias("asked"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sessions, online_state_loop, offline_epochs, online_prequential, response_cache_misses, tool_correlation, file_stats, context_completeness, early_stopping, completion_order)}
ORACLE = {
    "stream_tumbling": "SELECT CAST(day(ts) AS INT) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY date_trunc('day', ts), 1, 2",
    "stream_sessions": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, count(*) AS n, min(event_id) AS least_event FROM b GROUP BY user_id, s",
    "online_state_loop": "WITH e AS (SELECT CAST(day(ts) // 7 AS INT) AS week, user_id, value FROM events), p AS (SELECT week, value, avg(value) OVER (PARTITION BY user_id ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted FROM e) SELECT week, count(predicted) AS predicted, round(avg(abs(value - predicted)), 6) AS error FROM p GROUP BY 1",
    "offline_epochs": """WITH j AS (SELECT user_id, value FROM events WHERE event_id % 7 = 0), s AS (SELECT k.e AS epoch, user_id, avg(value) AS m FROM events, range(1, 6) k(e) WHERE event_id % 7 <> 0 AND event_id % 6 < k.e GROUP BY 1, 2),
x AS (SELECT k.e AS epoch, round(avg(abs(j.value - coalesce(s.m, 0))), 6) AS error FROM range(1, 6) k(e) CROSS JOIN j LEFT JOIN s ON s.epoch = k.e AND s.user_id = j.user_id GROUP BY 1),
b AS (SELECT *, (SELECT arg_min(y.epoch, (y.error, y.epoch)) FROM x y WHERE y.epoch <= x.epoch) AS best_so_far FROM x), c AS (SELECT coalesce(min(epoch), 5) AS last FROM b WHERE epoch - best_so_far >= 2)
SELECT CAST(b.epoch AS INT) AS epoch, error, b.epoch = (SELECT best_so_far FROM b z, c WHERE z.epoch = c.last) AS best, last < 5 AS stopped FROM b, c WHERE b.epoch <= last""",
    "online_prequential": "WITH e AS (SELECT CAST(day(ts) AS INT) AS day, user_id, value FROM events), p AS (SELECT day, value, avg(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted FROM e) SELECT day, count(predicted) AS predicted, round(avg(abs(value - predicted)), 6) AS error FROM p GROUP BY 1",
    "response_cache_misses": "WITH d AS (SELECT doc_id, sha256(concat_ws('|', 'model', lang, text)) AS key FROM documents) SELECT key, min(doc_id) AS first_request, count(*) AS requests FROM d WHERE doc_id % 3 <> 0 AND key NOT IN (SELECT key FROM d WHERE doc_id % 3 = 0) GROUP BY 1",
    "tool_correlation": "SELECT c.conv_id AS video_id, count(*) AS calls, count(r.text) AS answered, CAST(sum(length(c.text)) AS BIGINT) AS chars_in, CAST(sum(length(r.text)) AS BIGINT) AS chars_out FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant' WHERE c.role = 'user' GROUP BY 1",
    "file_stats": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS lines FROM events), w AS (SELECT user_id, lines AS written, ts AS wt, event_id AS we FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT e.user_id, count(*) FILTER (WHERE event_type = 'view') AS reads, CAST(coalesce(max(written), 0) + coalesce(sum(lines) FILTER (WHERE event_type = 'click' AND (wt IS NULL OR (ts, event_id) > (wt, we))), 0) AS BIGINT) AS lines FROM e LEFT JOIN w USING (user_id) GROUP BY 1""",
    "context_completeness": "SELECT conv_id AS video_id, CAST(count(*) FILTER (WHERE role = 'user') AS INT) AS requests, CAST(count(*) FILTER (WHERE length(text) < 20) AS INT) AS unattributed, count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE length(text) < 20) = 0 AS complete FROM conversations GROUP BY 1",
    "early_stopping": """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), w(c, seen, best, epoch) AS (SELECT c, k, x, k FROM o WHERE k = 1 UNION ALL
SELECT o.c, o.k, greatest(x, best), CASE WHEN x > best THEN o.k ELSE epoch END FROM w JOIN o ON o.c = w.c AND o.k = w.seen + 1 WHERE w.seen - w.epoch < 2) SELECT c AS customer, epoch AS best_epoch, seen AS epochs, best AS score FROM w QUALIFY row_number() OVER (PARTITION BY c ORDER BY seen DESC) = 1""",
    "completion_order": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS INT) AS arrived, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS asked FROM events",
}
