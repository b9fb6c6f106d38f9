"""Loaders and sinks on small files."""

import json

import pytest

from tempora.sources import annotations, sinks


def test_nested_annotations(spark, tmp_path):
    rec = {"key": "v1", "video_info": {"duration_minutes": 3}, "qa": [{"uid": "7", "question": "What is it?\nThe sign\n(A) red\n(B) blue", "answer": "B", "question_type": ["x"], "time_reference": "00:05-00:09"}, {"uid": "8", "question": "no options", "answer": "A", "question_type": [], "time_reference": ""}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(rec) + "\n\n{broken\n")
    schema = "key string, video_info struct<duration_minutes: string>, qa array<struct<uid: string, question: string, answer: string, question_type: array<string>, time_reference: string>>"
    rows = annotations.nested_annotations(annotations.read_jsonl(spark, str(tmp_path), schema)).collect()
    assert [(r.episode_id, r.question, r.options, r.answer, r.evidence.lo) for r in rows] == [("7", "What is it? The sign", ["red", "blue"], "B", 5)]


def test_flat_annotations_and_index(spark, tmp_path):
    for p in ("x/t1/a.mp4", "x/test/a.mp4", "x/other/b.mkv", "x/other/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    rows = spark.createDataFrame([("1", "a.mp4", "q", ["red", "blue"], "blue", "t1"), ("2", "a", "q", ["red", "blue"], "(A)", "t9"), ("3", "b", "q", ["red", "blue"], "green", "t1")], "qid string, video string, question string, candidates array<string>, answer string, task_type string")
    e = annotations.flat_annotations(rows)
    got = {r.episode_id: (r.answer, r.path.rsplit("/x/")[1]) for r in annotations.resolve_videos(e, annotations.file_index(spark, str(tmp_path))).collect()}
    assert got == {"1": ("B", "t1/a.mp4"), "2": ("A", "test/a.mp4")}


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", "m", "x", i, "A", "A" if i % 2 else "B", bool(i % 2)) for i in range(4)], "dataset string, memory string, model string, qidx int, prediction string, target string, was_correct boolean")
    sinks.write_results(rows, str(tmp_path / "r"))
    docs = annotations.result_documents(spark, str(tmp_path / "r"), "accuracy double, total long, results array<struct<qidx: int, was_correct: boolean>>")
    assert docs.first().accuracy == 0.5
    assert sorted(r.was_correct for r in annotations.correctness(docs.select("file", "results")).collect()) == [False, False, True, True]


def test_trace_gate(spark, tmp_path):
    good = spark.createDataFrame([("q", ["r"], 0, 0)], "question_id string, requests array<string>, unattributed int, request_errors int")
    sinks.write_traces(good, str(tmp_path / "good"))
    with pytest.raises(ValueError, match="incomplete"):
        sinks.write_traces(good.withColumn("unattributed", good.unattributed + 1), str(tmp_path / "bad"))


def test_overrides(spark):
    d = spark.createDataFrame([("a", 1, 2), ("b", 1, 2)], "ds string, k int, n int")
    o = spark.createDataFrame([("a", 9)], "ds string, k int")
    assert {r.ds: (r.k, r.n) for r in annotations.with_overrides(d, o, "ds").collect()} == {"a": (9, 2), "b": (1, 2)}


def test_log_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("t", "x" * 30)], "title string, body string")
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert "[section cut]" in sinks.markdown_sections(rows, 10).first().pack
