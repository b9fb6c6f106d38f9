"""Files of every kind the engine reads and writes: written from the bundled tables, read back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.plans.leaderboard import ORACLE as LEADERBOARD
from tempora.plans.leaderboard import frontier_argmax
from tempora.sources import annotations as an
from tempora.sources import sinks
from tempora.sources.tables import captions, judged, table
from tempora.streaming.runs import work_folder

QA = "key string, video_info struct<duration_minutes: double>, qa array<struct<uid: string, question: string, answer: string, question_type: array<string>, time_reference: string>>"
FLAT = "question_id string, video_name string, question string, candidates array<string>, answer string, task_type string, duration double"


def nested_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions nested in line-wise JSON, some lines broken, options as lines of the question; only allowed videos."""
    b = table(spark, sf_dir, "benchmark")
    options = F.when(F.col("item_id") % 5 == 4, F.lit("\n(A) only")).otherwise(F.lit("\n(A) red\n(B) blue\n(C) green"))
    one = F.struct(F.col("item_id").cast("string").alias("uid"), F.concat(F.regexp_replace(F.left("text", F.lit(30)), r"\\s+", " "), options).alias("question"), F.lit("b ").alias("answer"), F.array(F.lit("kind")).alias("question_type"), F.lit("00:05-01:10").alias("time_reference"))
    doc = F.to_json(F.struct(F.concat(F.lit("v"), F.col("item_id") % 7).alias("key"), F.struct((F.col("item_id") * 1.5).alias("duration_minutes")).alias("video_info"), F.array(one).alias("qa")))
    path = f"{work_folder(spark)}/nested"
    b.select(F.when(F.col("item_id") % 6 == 5, "{broken").otherwise(doc).alias("value")).write.text(path)
    e = an.nested_annotations(an.allowed(an.read_jsonl(spark, path, QA), "key", ["v0", "v1", "v2", "v3"]))
    return e.select("episode_id", "video", "question", F.size("options").alias("options"), "answer", "evidence.lo", "evidence.hi")


def flat_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records, bare or under ``data``, in JSON and in Parquet; invalid ones are dropped."""
    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    rec = b.select(
        k.cast("string").alias("question_id"), F.when(k % 7 != 3, F.concat(F.lit("clip"), k, F.lit(".mp4"))).alias("video_name"), F.left("text", F.lit(20)).alias("question"),
        F.array(F.lit("one"), F.lit("two"), F.lit("three")).alias("candidates"), F.when(k % 3 == 0, "two").when(k % 3 == 1, "C").otherwise("nine").alias("answer"), F.lit("task").alias("task_type"), (k * 2.0).alias("duration"),
    )
    folder = work_folder(spark)
    rec.where("question_id % 2 = 0").write.parquet(f"{folder}/flat")
    odd = rec.where("question_id % 2 = 1")
    odd.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("data"))).alias("value")).write.text(f"{folder}/wrapped")
    both = an.read_records(spark, f"{folder}/flat", FLAT).unionByName(an.read_records(spark, f"{folder}/wrapped", FLAT))
    return an.flat_annotations(both).select("episode_id", "video", "answer", F.size("options").alias("options"), "duration")


def tagged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file for each task, records tagged with the file they come from."""
    e = table(spark, sf_dir, "events")
    path = f"{work_folder(spark)}/tasks"
    e.groupBy("event_type").agg(F.to_json(F.collect_list(F.struct("event_id", "value"))).alias("value")).write.partitionBy("event_type").text(path)
    # Writers name part files themselves, so the task is the folder here; a tag by file name is read the same way.
    read = an.read_tagged(spark, f"{path}/*", "event_id long, value double", form=r"event_type=([^/]+)/")
    return read.select("event_id", "value", "task_type")


def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations joined with a file index: the baked path where the index has it, else the task's folder, else a test folder, else any."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("f"), F.col("s_suppkey") % 20, F.lit(".mp4"))
    folder = F.element_at(F.array(F.lit("/a/test/"), F.lit("/b/count/"), F.lit("/c/other/")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    index = s.select(name.alias("name"), F.concat(folder, name).alias("path")).distinct()
    episodes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("episode_id"), F.concat(F.lit("f"), F.col("item_id") % 25, F.lit(".mp4")).alias("video"), F.when(F.col("item_id") % 2 == 0, "count").otherwise("order").alias("task_type"), F.when(F.col("item_id") % 4 == 1, F.concat(F.lit("/c/other/f"), F.col("item_id") % 25, F.lit(".mp4"))).alias("baked"))
    return an.resolve_videos(episodes, index, baked="baked").select("episode_id", "path")


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents written in folders by key, found again below their root with the key their path states, and taken apart."""
    j = judged(spark, sf_dir).where("lang IS NOT NULL")
    rows = j.select(F.lit("docs").alias("dataset"), "lang", F.regexp_replace("source", "src", "Model").alias("model"), "qidx", F.lit("A").alias("prediction"), F.lit("B").alias("target"), F.col("ref_ok").alias("was_correct")).withColumnRenamed("lang", "memory")
    path = f"{work_folder(spark)}/results"
    sinks.write_results(rows, path)
    schema = "accuracy double, correct long, total long, parse_fail long, prediction_counts map<string, long>, results array<struct<qidx: long, prediction: string, target: string, was_correct: boolean>>"
    docs = an.result_documents(spark, path, schema)
    q = an.correctness(docs)
    return q.groupBy("memory", "model").agg(F.max("accuracy").alias("accuracy"), F.max("total").alias("total"), F.count(F.lit(1)).alias("questions"), F.sum(F.col("was_correct").cast("long")).alias("right")).select("memory", "model", F.round("accuracy", 9).alias("accuracy"), "total", "questions", "right")


def trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces written through the completeness gate and read back; incomplete ones would fail the write."""
    c = captions(spark, sf_dir).where("role = 'user'")
    t = c.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_index", F.length("caption").alias("chars")))).alias("requests"))
    t = t.select("video_id", "requests", F.lit(0).cast("long").alias("unattributed"), F.lit(0).cast("long").alias("request_errors"))
    path = f"{work_folder(spark)}/traces"
    sinks.write_traces(t, path)
    return spark.read.schema(t.schema).json(path).select("video_id", F.size("requests").alias("requests"))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's log: rows appended in two steps with the time since it began, and tailed as a stream."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    start = e.agg(F.min("ts")).first()[0]
    path = f"{work_folder(spark)}/log"
    for odd in (0, 1):
        sinks.append_log(e.where(F.col("event_id") % 2 == odd), path, start)
    return an.tail_log(spark, path, "t double, event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("t"), 3).alias("last_t"))


def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of candidates as JSON lines, broken ones skipped."""
    o = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 11 == 3, "{oops").otherwise(F.to_json(F.struct(F.month("o_orderdate").alias("iteration"), F.col("o_orderkey").cast("string").alias("system"), F.col("o_totalprice").alias("avg_val"))))
    path = f"{work_folder(spark)}/ledger"
    o.select(line.alias("value")).write.text(path)
    read = an.read_jsonl(spark, path, "iteration int, system string, avg_val double")
    return read.groupBy("iteration").agg(F.count(F.lit(1)).alias("systems"), F.max("avg_val").alias("best"))


def frontier_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier written as a document for each dataset and read back."""
    path = f"{work_folder(spark)}/frontier"
    sinks.write_frontier(frontier_argmax(spark, sf_dir), path)
    f = spark.read.schema("dataset int, frontier string").json(path)
    return f.select("dataset", F.get_json_object("frontier", "$.model").alias("model"), F.get_json_object("frontier", "$.accuracy").cast("double").alias("accuracy"))


def archive_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sections of an archive: each capped, and the whole capped, in order."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("at"), F.col("url").alias("title"), F.col("html").alias("body"))
    return sinks.markdown_pack(p, 400, 9_000).select("at", F.length("pack").alias("chars"), F.md5("pack").alias("pack_md5"))


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent's events as line-wise JSON: calls with the results that name them, by tool."""
    e = table(spark, sf_dir, "events")
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("event_id")).alias("id"), F.col("event_type").alias("name"))).alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), F.col("event_id")).alias("tool_use_id"), (F.col("event_id") % 9 == 0).alias("is_error"))).alias("content")).alias("message")))
    path = f"{work_folder(spark)}/events"
    e.select(F.explode(F.array(use, F.when(F.col("event_id") % 4 != 0, result).otherwise("not json"))).alias("value")).write.text(path)
    t = an.tool_calls(an.read_jsonl(spark, path, an.AGENT_EVENT))
    return t.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.count("is_error").alias("answered"), F.count_if("is_error").alias("errors"))


def config_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each dataset: its own where it has any, else the default."""
    n = table(spark, sf_dir, "nation")
    defaults = n.select("n_name", F.lit(40).alias("budget"), F.lit(42).alias("seed"))
    own = n.where("n_regionkey < 2").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("budget"))
    return an.with_overrides(defaults, own, "n_name")


QUERIES = {f.__name__: f for f in (nested_scan, flat_scan, tagged_scan, path_resolution, result_files, trace_files, log_files, ledger_files, frontier_file, archive_pack, agent_events, config_overrides)}
ORACLE = {
    "frontier_file": "SELECT dataset, model, accuracy FROM (" + LEADERBOARD["frontier_argmax"] + ")",
    "nested_scan": """SELECT item_id::VARCHAR AS episode_id, 'v' || item_id % 7 AS video, trim(regexp_replace(left(text, 30), '\\s+', ' ', 'g')) AS question, CAST(3 AS INT) AS options, 'B' AS answer, CAST(5 AS BIGINT) AS lo, CAST(70 AS BIGINT) AS hi
FROM benchmark WHERE item_id % 6 <> 5 AND item_id % 5 <> 4 AND item_id % 7 < 4""",
    "flat_scan": "SELECT item_id::VARCHAR AS episode_id, 'clip' || item_id || '.mp4' AS video, CASE WHEN item_id % 3 = 0 THEN 'B' ELSE 'C' END AS answer, CAST(3 AS INT) AS options, (item_id * 2) || '.0' AS duration FROM benchmark WHERE item_id % 7 <> 3 AND item_id % 3 <> 2",
    "tagged_scan": "SELECT event_id, value, event_type AS task_type FROM events",
    "path_resolution": """WITH x AS (SELECT DISTINCT 'f' || s_suppkey % 20 || '.mp4' AS name, (['/a/test/', '/b/count/', '/c/other/'])[s_suppkey % 3 + 1] || 'f' || s_suppkey % 20 || '.mp4' AS path FROM supplier),
e AS (SELECT item_id, 'f' || item_id % 25 || '.mp4' AS video, CASE WHEN item_id % 2 = 0 THEN 'count' ELSE 'order' END AS task, CASE WHEN item_id % 4 = 1 THEN '/c/other/f' || item_id % 25 || '.mp4' END AS baked FROM benchmark)
SELECT item_id AS episode_id, path FROM e JOIN x ON name = video QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN path = baked THEN 0 WHEN contains(path, '/' || task || '/') THEN 1 WHEN contains(path, '/test/') THEN 2 ELSE 3 END, path) = 1""",
    "result_files": "SELECT d.lang AS memory, replace(d.source, 'src', 'Model') AS model, round(avg(CAST(quality = 1 AS DOUBLE)), 9) AS accuracy, count(*) AS total, count(*) AS questions, count(*) FILTER (WHERE quality = 1) AS right FROM labels l JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL GROUP BY 1, 2",
    "trace_files": "SELECT conv_id AS video_id, CAST(count(*) AS INT) AS requests FROM conversations WHERE role = 'user' GROUP BY 1",
    "log_files": "SELECT event_type, count(*) AS rows, round(max(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6, 3) AS last_t FROM events GROUP BY 1",
    "ledger_files": "SELECT CAST(month(o_orderdate) AS INT) AS iteration, count(*) AS systems, max(o_totalprice) AS best FROM orders WHERE o_orderkey % 11 <> 3 GROUP BY 1",
    "archive_pack": """WITH s AS (SELECT page_id AS "at", '## ' || url || chr(10) || chr(10) || CASE WHEN length(html) > 400 THEN left(html, 400) || chr(10) || '[section cut]' || chr(10) ELSE html END || chr(10) AS pack FROM pages), c AS (SELECT *, sum(length(pack)) OVER (ORDER BY "at") AS upto FROM s)
SELECT "at", CAST(length(pack) AS INT) AS chars, md5(pack) AS pack_md5 FROM c WHERE upto <= 9000""",
    "agent_events": "SELECT event_type AS name, count(*) AS calls, count(*) FILTER (WHERE event_id % 4 <> 0) AS answered, count(*) FILTER (WHERE event_id % 4 <> 0 AND event_id % 9 = 0) AS errors FROM events GROUP BY 1",
    "config_overrides": "SELECT n_name, CAST(CASE WHEN n_regionkey < 2 AND n_nationkey % 2 = 0 THEN n_nationkey ELSE 40 END AS INT) AS budget, CAST(42 AS INT) AS seed FROM nation",
}
