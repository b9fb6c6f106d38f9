"""Scalar functions on the cases that matter, and published statistics."""

import pytest
from pyspark.sql import functions as F

from tempora.functions import models, stats
from tempora.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def options(*values):
    return F.array(*[F.lit(x) for x in values])


@pytest.mark.parametrize(
    ("reply", "letter"),
    [("(B)", "B"), ("final_answer: C", "C"), ("<think>A</think>\nB", "B"), ("", "?"), ("E", "?"), ("first red then blue I think", "B"), ("B) because of the sign in the back", "B"), ("None can be told", "?")],
)
def test_normalize_choice(spark, reply, letter):
    assert one(spark, tx.normalize_choice(F.lit(reply), options("A. red", "B. blue", "C. green", "D. yellow"))) == letter


@pytest.mark.parametrize(
    ("text", "value"),
    [('{"final_answer": "B"}', "B"), ('x\n```json\n{"final_answer": "C"}\n```', "C"), ('{"final_answer": "A", "final_answer": "D"', "D"), ('{"final_answer": B', "B"), ('{"final_answer": "B', "")],
)
def test_json_field(spark, text, value):
    assert one(spark, tx.json_field(F.lit(text), "final_answer")) == value


@pytest.mark.parametrize(("text", "lo", "hi"), [("01:05-01:20", 65, 80), ("1:00:00-1:00:05", 3600, 3605), ("05:00-04:00", 300, 300), ("none-01:00", None, None), ("0105", None, None)])
def test_time_reference(spark, text, lo, hi):
    found = one(spark, tx.time_reference(F.lit(text)))
    assert found is None if lo is None else (found.lo, found.hi) == (lo, hi)


@pytest.mark.parametrize(("question", "duration", "lo", "hi"), [("from 37:30-38:05", 3600.0, 2250, 2285), ("at 21:57", 3600.0, 1311, 1323), ("at 21:57", 60.0, None, None), ("no clock", 60.0, None, None)])
def test_stated_interval(spark, question, duration, lo, hi):
    found = one(spark, tx.stated_interval(F.lit(question), F.lit(duration)))
    assert found is None if lo is None else (found.lo, found.hi) == (lo, hi)


def test_cardinality(spark):
    numbers, minutes = options("3", "5", "6", "7"), options("3 minutes", "5 minutes", "6", "7")
    assert one(spark, tx.is_cardinality(F.lit("How many goals?"), numbers))
    assert not one(spark, tx.is_cardinality(F.lit("How many goals?"), minutes))


def test_numbered_captions(spark):
    assert one(spark, tx.numbered_captions(F.lit("Sure\n1. a dog\nruns\n2. a cat"), 2)) == ["a dog runs", "a cat"]
    assert one(spark, tx.numbered_captions(F.lit("1. a dog"), 2)) is None


def test_token_cost(spark):
    assert one(spark, tx.token_cost(F.lit(224), F.lit(224))) == 64
    assert one(spark, tx.token_cost(F.lit(20), F.lit(20))) == 1


def test_ledger(spark):
    assert one(spark, tx.ledger_items(F.lit("1. [3s] a\n- b\nplain"))) == ["1. [3s] a", "- b"]
    assert one(spark, tx.ledger_items(F.lit(" none. "))) == []


def test_published_statistics(spark):
    low, high = stats.wilson(F.lit(483), F.lit(882))
    assert (round(one(spark, low), 2), round(one(spark, high), 2)) == (51.46, 58.02)
    for b01, b10, p in ((63, 135, 3.39155e-7), (78, 127, 7.607e-4), (46, 69, 0.0398), (59, 171, 7.907e-14), (22, 52, 6.43e-4), (31, 83, 1.18e-6)):
        assert one(spark, stats.mcnemar(F.lit(b01), F.lit(b10))) == pytest.approx(p, rel=5e-3)
    assert one(spark, stats.mcnemar(F.lit(0), F.lit(0))) == 1


def test_model_calls_fall_back_row_by_row(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id long, prompt string")

    def model(prompts):
        if len(prompts) > 1 and "p3" in prompts:
            return ["short"]
        if prompts == ["p4"]:
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    got = {r.id: r.reply for r in models.call(rows, "prompt", model, size=3).collect()}
    assert [got[i] for i in range(4)] == ["P0", "P1", "P2", "P3"] and got[4] is None


def test_cache(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "prompt string, id int").withColumn("key", models.request_key(F.col("prompt")))
    cache = rows.where("prompt = 'a'").limit(1).select("key", F.lit("cached").alias("reply"))
    told, fresh = models.through_cache(rows, cache, "prompt", lambda p: [x + "!" for x in p])
    assert {r.id: r.reply for r in told.collect()} == {1: "cached", 2: "b!", 3: "cached"}
    assert fresh.count() == 1
