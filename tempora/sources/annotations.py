"""Question annotations, file indexes, result documents and logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions import text as tx

EPISODE_COLUMNS = ("episode_id", "video", "question", "options", "answer", "task_type", "duration")


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exist and is not null, as text."""
    held = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def flat_annotations(df: DataFrame) -> DataFrame:
    """Episodes of flat records, whose names for a field differ; invalid ones are dropped.

    A record is valid with a video, a question, two options or more, and an answer that names one of them.
    """
    options = F.col("candidates") if "candidates" in df.columns else F.col("options")
    e = df.select(
        _first(df, "question_id", "qid").alias("episode_id"),
        _first(df, "video_name", "video", "video_path").alias("video"),
        F.col("question"),
        options.cast("array<string>").alias("options"),
        tx.answer_letter(F.col("answer").cast("string"), options.cast("array<string>")).alias("answer"),
        _first(df, "task_type", "question_type").alias("task_type"),
        _first(df, "duration").alias("duration"),
    )
    return e.where(F.col("video").isNotNull() & (F.length(F.trim("question")) > 0) & (F.size("options") >= 2) & F.col("answer").isNotNull())


def nested_annotations(df: DataFrame) -> DataFrame:
    """Episodes of records with a list of questions each, whose options are lines of the question's text."""
    q = df.select(F.col("key").alias("video"), F.col("video_info.duration_minutes").cast("string").alias("duration"), F.explode("qa").alias("qa"))
    lines = F.filter(F.transform(F.split("qa.question", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.filter(lines, lambda x: x.rlike(r"^\([A-H]\)"))
    first = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\([A-H]\)")), True)
    stem = F.array_join(F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines), " ")
    e = q.select(
        F.col("qa.uid").cast("string").alias("episode_id"),
        "video",
        stem.alias("question"),
        F.transform(listed, lambda x: F.trim(F.regexp_replace(x, r"^\([A-H]\)", ""))).alias("options"),
        F.upper(F.trim("qa.answer")).alias("answer"),
        F.element_at("qa.question_type", 1).alias("task_type"),
        "duration",
        tx.time_reference(F.col("qa.time_reference")).alias("evidence"),
    )
    return e.where((F.size("options") >= 2) & (F.ascii("answer") - 65 < F.size("options")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a line-wise JSON file; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def allowed(records: DataFrame, key: str, keys: list[str] | None) -> DataFrame:
    """Records of the keys listed; all without a list."""
    return records if not keys else records.where(F.col(key).isin(*keys))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of Parquet files, of JSON arrays, or of JSON documents that hold them under ``data``.

    The kind is told by the files' names; columns that are missing are null.
    """
    names = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(1).collect()]
    want = spark.createDataFrame([], schema).schema
    if names and names[0].endswith(".parquet"):
        return spark.read.schema(want).parquet(path)
    whole = spark.read.option("wholetext", True).text(path)
    bare = F.from_json("value", f"array<{want.simpleString()}>")
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.from_json("value", f"struct<data: array<{want.simpleString()}>>")["data"])
    return whole.select(F.explode(rows).alias("x")).select("x.*")


def read_tagged(spark: SparkSession, path: str, schema: str, tag: str = "task_type", form: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """JSON files of a folder, each record with a tag out of its file's path (by default the file's stem)."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), form, 1)
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", stem.alias(tag))


def tail_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stream over an appended log of JSON lines has read when it has caught up."""
    from tempora.streaming.runs import final_state

    return final_state(spark.readStream.schema(schema).json(path))


#: An agent's event: messages whose parts are calls of tools, or results that name a call.
AGENT_EVENT = "type string, message struct<content: array<struct<type: string, id: string, name: string, tool_use_id: string, is_error: boolean>>>"


def tool_calls(events: DataFrame) -> DataFrame:
    """``id, name, is_error`` of every call in agent events; ``is_error`` is null where no result came."""
    parts = events.select(F.explode("message.content").alias("p")).select("p.*")
    results = parts.where("type = 'tool_result'").groupBy(F.col("tool_use_id").alias("id")).agg(F.max(F.coalesce("is_error", F.lit(False))).alias("is_error"))
    return parts.where("type = 'tool_use'").select("id", "name").join(results, "id", "left")


def file_index(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp4", "mkv", "webm", "avi", "mov")) -> DataFrame:
    """``name, path`` of all files below a folder, by base name and by stem; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    base = F.element_at(F.split("path", "/"), -1)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return kept.select(F.explode(F.array_distinct(F.array(base, F.regexp_replace(base, r"\.[^.]+$", "")))).alias("name"), "path")


def resolve_videos(episodes: DataFrame, index: DataFrame, prefer: str = "/test/", baked: str | None = None) -> DataFrame:
    """Episodes with the path of their video: the path they state if the index has it, then a folder named like the task, then ``prefer``, then any."""
    j = episodes.join(index.withColumnRenamed("name", "video"), "video")
    rank = F.when(F.instr(F.col("path"), F.concat(F.lit("/"), F.col("task_type"), F.lit("/"))) > 0, 1).when(F.instr("path", prefer) > 0, 2).otherwise(3)
    if baked:
        rank = F.when(F.col("path") == F.col(baked), 0).otherwise(rank)
    order = Window.partitionBy("episode_id").orderBy(rank, "path")
    return j.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def result_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files below a folder with the run key their path states (``dataset, memory, model, seed``); broken files are skipped."""
    docs = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "DROPMALFORMED").json(path)
    file = F.col("_metadata.file_path")
    part = lambda name: F.nullif(F.regexp_extract(file, f"/{name}=([^/]+)/", 1), F.lit(""))
    key = tx.run_key(file)
    stated = [F.coalesce(part(c), F.nullif(key[c], F.lit(""))).alias(c) for c in ("dataset", "memory", "model")]
    return docs.select("*", file.alias("file"), *stated, key["seed"].alias("seed"))


def correctness(documents: DataFrame) -> DataFrame:
    """One row for each question of result documents, in order."""
    keep = [c for c in documents.columns if c != "results"]
    rows = documents.select(*keep, F.posexplode("results").alias("at", "result"))
    return rows.select(*keep, "at", "result.*")


def with_overrides(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Settings of each dataset: its own where it has any, else the default."""
    shared = [c for c in defaults.columns if c != key and c in overrides.columns]
    o = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in shared])
    return defaults.join(o, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in shared else F.col(c) for c in defaults.columns if c != key])
