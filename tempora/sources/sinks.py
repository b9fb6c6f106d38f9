"""Result documents, traces, logs and reports as files, written by Spark's commit protocol."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_results(rows: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "memory", "model")) -> None:
    """One JSON document for each run: header (counts, shares, answers by letter) and questions in order, in folders by key."""
    letter = F.coalesce(F.nullif(F.upper(F.trim("prediction")), F.lit("")), F.lit("?"))
    questions = F.array_sort(F.collect_list(F.struct("qidx", "prediction", "target", "was_correct")))
    ok, failed = F.col("was_correct").cast("long"), (F.col("_letter") == "?").cast("long")
    rows = rows.withColumn("_letter", letter)
    docs = rows.groupBy(*keys).agg(
        F.avg(ok.cast("double")).alias("accuracy"), F.sum(ok).alias("correct"), F.count(F.lit(1)).alias("total"), F.sum(failed).alias("parse_fail"),
        F.sum(1 - failed).alias("valid_predictions"), F.coalesce(F.avg(F.when(F.col("_letter") != "?", ok.cast("double"))), F.lit(0.0)).alias("valid_accuracy"), questions.alias("results"),
    )
    letters = rows.groupBy(*keys, "_letter").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_letter", "n")))).alias("prediction_counts"))
    docs.join(letters, list(keys)).withColumn("timestamp", F.current_timestamp()).write.mode("overwrite").partitionBy(*keys).json(path)


def write_traces(traces: DataFrame, path: str) -> None:
    """Traces as JSON lines, then the gate: an incomplete trace fails the write.

    Lines are written first, so what failed can be read.
    """
    traces.write.mode("overwrite").json(path)
    back = traces.sparkSession.read.schema(traces.schema).json(path)
    broken = back.where((F.size("requests") == 0) | (F.col("unattributed") > 0) | (F.col("request_errors") > 0)).count()
    if broken:
        raise ValueError(f"{broken} traces are incomplete")


def append_log(rows: DataFrame, path: str, start: datetime | None = None, time: str = "ts") -> None:
    """Append rows to a log of JSON lines; with ``start``, their time becomes ``t``, seconds since then."""
    if start is not None:
        begun = F.unix_micros(F.lit(start).cast("timestamp"))
        rows = rows.select(((F.unix_micros(time) - begun) / 1e6).alias("t"), *[c for c in rows.columns if c != time])
    rows.write.mode("append").json(path)


def write_frontier(best: DataFrame, path: str) -> None:
    """The frontier as one JSON document a dataset."""
    best.select("dataset", F.to_json(F.struct(*[c for c in best.columns if c != "dataset"])).alias("frontier")).write.mode("overwrite").json(path)


def markdown_sections(rows: DataFrame, most: int = 16_000, *keep: str) -> DataFrame:
    """``pack``: sections ``title, body`` as Markdown, each capped with a notice."""
    capped = F.when(F.length("body") > most, F.concat(F.left("body", F.lit(most)), F.lit("\n[section cut]\n"))).otherwise(F.col("body"))
    return rows.select(*keep, "title", F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), capped, F.lit("\n")).alias("pack"))


def markdown_pack(rows: DataFrame, most: int = 16_000, total: int = 180_000, order: str = "at") -> DataFrame:
    """``at, pack``: sections in order as long as all together stay within ``total``."""
    packed = markdown_sections(rows, most, order)
    upto = F.sum(F.length("pack")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # Sections beyond the total cannot matter, so no more than it could hold (a character each) are put in order.
    few = packed.orderBy(order).limit(total)
    return few.withColumn("_upto", upto).where(F.col("_upto") <= total).select(order, "pack")
