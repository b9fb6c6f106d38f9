"""Replies and questions taken apart where their form is loose, as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions import text as tx

#: Forms of clocks, joiners of two clocks and named blocks (fixed values).
SPAN_CLOCK = r"(?<![\d:.])(\d{1,3}:[0-5]\d(?::[0-5]\d)?)(?![\d:.])"
JOINER = r"\s*(?:-{1,2}|–|—|~|to|until|till|through)\s*\z"
JSON_BLOCK = r"(?s)(?:\*\*`?([^`*\n]+\.json)`?\*\*[: \t]*\n)?```json\s*\n(.*?)```"
OFF_WORDS = ("0", "false", "no", "off")

CLIP_SECONDS = 16.0
RETRIEVED = 4
MOST_EVENTS = 4
MOST_INDEXES = 8


def _either(first: Column, *rest: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (first, *rest)])


def time_spans(question: Column, duration: Column) -> Column:
    """Clocks of a question as an array of ``lo, hi`` seconds, in order; two that a dash or "to" joins are one span.

    Clocks beyond the duration are dropped; without a duration there are none.
    """
    times = F.transform(F.regexp_extract_all(question, F.lit(SPAN_CLOCK), 1), lambda c: tx.seconds(c).cast("double"))
    between = F.split(question, SPAN_CLOCK, -1)
    span = "array<struct<lo: double, hi: double>>"
    zero = F.struct(F.array().cast(span).alias("spans"), F.lit(False).alias("skip"))

    def step(a: Column, i: Column) -> Column:
        t0, t1 = F.get(times, i), F.get(times, i + 1)
        joined = F.coalesce(F.get(between, i + 1).rlike(JOINER) & (t0 <= t1) & (t1 <= duration), F.lit(False))
        hi = F.when(joined, t1).otherwise(t0)
        used = ~a["skip"] & (t0 <= duration)
        more = F.concat(a["spans"], F.array(F.struct(t0.alias("lo"), hi.alias("hi"))))
        return F.struct(F.when(used, more).otherwise(a["spans"]).alias("spans"), (used & joined).alias("skip"))

    places = F.when(F.size(times) > 0, F.sequence(F.lit(0), F.size(times) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(duration, F.lit(0.0)) > 0, F.aggregate(places, zero, step, lambda a: a["spans"])).otherwise(F.array().cast(span))


def span_clock(lo: Column, hi: Column) -> Column:
    """A span in clock form and in seconds: ``m:ss-m:ss (=as-bs)``, or one clock for an instant."""
    def at(t: Column) -> Column:
        return tx.clock(F.bround(t, 0))

    def whole(t: Column) -> Column:
        return F.concat(F.bround(t, 0).cast("long").cast("string"), F.lit("s"))

    point = F.concat(at(lo), F.lit(" (="), whole(lo), F.lit(")"))
    return F.when(F.abs(hi - lo) < 0.5, point).otherwise(F.concat(at(lo), F.lit("-"), at(hi), F.lit(" (="), whole(lo), F.lit("-"), whole(hi), F.lit(")")))


def _listed(raw: Column) -> Column:
    """Whole numbers of a JSON list, or of what is one in brackets; null if neither can be read."""
    text = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    items = F.from_json(text, "array<string>")
    readable = F.try_parse_json(text).isNotNull()
    return F.when(readable, F.transform(F.filter(items, lambda x: x.rlike(r"^-?\d+$")), lambda x: x.cast("long")))


def _numbers(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.cast("long"))


def frame_indexes(reply: Column, n: Column) -> Column:
    """Frames that a reply names: its JSON list, else numbers in brackets, else bare ones (eight at most)."""
    raw = F.nullif(tx.json_field(reply, "relevant_indices"), F.lit(""))
    listed = F.filter(_listed(raw), lambda i: (i >= 0) & (i < n))
    fits = lambda x: F.slice(F.filter(x, lambda i: i < n), 1, MOST_INDEXES)
    marked = _numbers(reply, r"\[(\d+)\]")
    bare = _numbers(F.coalesce(raw, F.lit("")), r"\b(\d{1,2})\b")
    return F.when(listed.isNotNull(), listed).when(F.size(marked) > 0, fits(marked)).otherwise(fits(bare))


def event_indexes(reply: Column, n: Column) -> Column:
    """Events (from 0) that a reply names (from 1): its JSON list, else "Event 3", else bare numbers (four at most)."""
    raw = F.nullif(tx.json_field(reply, "relevant_events"), F.lit(""))
    fits = lambda x: F.filter(x, lambda i: (i >= 1) & (i <= n))
    told = lambda x: F.transform(x, lambda i: i - 1)
    listed = _listed(raw)
    marked = _numbers(reply, r"Event\s*(\d+)")
    bare = _numbers(F.coalesce(raw, F.lit("")), r"\b(\d{1,2})\b")
    return told(F.when(listed.isNotNull(), fits(listed)).when(F.size(marked) > 0, F.slice(fits(marked), 1, MOST_EVENTS)).otherwise(F.slice(fits(bare), 1, MOST_EVENTS)))


def _object(reply: Column) -> Column:
    """From the first brace to the last, if that is a JSON object."""
    block = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.json_object_keys(block).isNotNull(), block)


def planner_action(reply: Column) -> Column:
    """A planner's reply as ``action, query, top_k, t0, t1``; what is no JSON is searched for its action."""
    data, up = _object(reply), F.upper(F.coalesce(reply, F.lit("")))
    field = lambda name: F.nullif(F.get_json_object(data, f"$.{name}"), F.lit(""))
    numbers = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    asked = F.upper(F.trim(F.coalesce(field("action"), F.lit(""))))
    kind = F.when(data.isNull(), F.when(up.contains("STOP"), "Stop").when(up.contains("INSPECT"), "VisualInspect").otherwise("VisualRetrieve"))
    kind = F.coalesce(kind, F.when(asked == "STOP", "Stop").when(asked.contains("INSPECT"), "VisualInspect").otherwise("VisualRetrieve"))
    t0 = F.coalesce(F.try_to_number(field("t0"), F.lit("999999999.999")).cast("double"), F.get(numbers, F.lit(0)), F.lit(0.0))
    t1 = F.coalesce(F.try_to_number(field("t1"), F.lit("999999999.999")).cast("double"), F.get(numbers, F.lit(1)), t0 + CLIP_SECONDS)
    inspect, retrieve = kind == "VisualInspect", kind == "VisualRetrieve"
    query = F.when(data.isNull(), tx.json_field(reply, "query", "key evidence")).otherwise(field("query"))
    top_k = F.nullif(field("top_k").cast("int"), F.lit(0))
    return F.struct(
        kind.alias("action"),
        F.when(retrieve, _either(query, F.lit("key evidence"))).alias("query"),
        F.when(retrieve, F.coalesce(top_k, F.lit(RETRIEVED))).alias("top_k"),
        F.when(inspect, t0).alias("t0"),
        F.when(inspect, F.when(data.isNotNull() & (t1 == 0), t0 + CLIP_SECONDS).otherwise(t1)).alias("t1"),
    )


def inspection(reply: Column, options: Column) -> Column:
    """An inspector's reply as ``sufficient, feedback, final_answer``; what is no JSON is feedback and searched for a letter."""
    data = _object(reply)
    field = lambda name: F.get_json_object(data, f"$.{name}")
    enough = F.trim(field("sufficient"))
    sufficient = F.coalesce(enough.isin("1", "true", "True") | (enough.try_cast("double") != 0), F.lit(False))
    text = F.coalesce(reply, F.lit(""))
    letter = tx.normalize_choice(F.when(data.isNotNull(), F.coalesce(field("final_answer"), F.lit(""))).otherwise(text), options)
    return F.struct(
        sufficient.cast("int").alias("sufficient"),
        F.coalesce(F.nullif(F.trim(field("feedback")), F.lit("")), F.left(text, F.lit(240))).alias("feedback"),
        F.when(letter == "?", "").otherwise(letter).alias("final_answer"),
    )


def json_blocks(text: Column) -> Column:
    """Fenced JSON blocks that can be read, as ``name, body``; the name comes from a bold line before the fence."""
    names, bodies = F.regexp_extract_all(text, F.lit(JSON_BLOCK), 1), F.regexp_extract_all(text, F.lit(JSON_BLOCK), 2)
    both = F.zip_with(names, bodies, lambda n, b: F.struct(F.nullif(F.element_at(F.split(n, "/"), -1), F.lit("")).alias("name"), F.btrim(b, F.lit(" \t\n\r")).alias("body")))
    return F.filter(both, lambda x: F.try_parse_json(x["body"]).isNotNull())


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object of a text, whatever stands around it."""
    decoder = json.JSONDecoder()

    def find(text: str | None) -> str | None:
        at = (text or "").find("{")
        while at >= 0:
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(find)


def truthy(setting: Column) -> Column:
    """Whether a setting is on: unset and blank ones are."""
    word = F.lower(F.trim(setting))
    return F.coalesce(word, F.lit("")).isin("") | ~F.coalesce(word, F.lit("")).isin(*OFF_WORDS)


def final_channel(reply: Column) -> Column:
    """The message of the channel ``final`` of a reply in channels, else the last message, else the reply."""
    end = r"(.*?)(?:<\|end\|>|<\|return\|>|<\|start\|>|<\|channel\|>|\z)"
    final = F.regexp_extract_all(reply, F.lit(r"(?s)<\|channel\|>final[^<]*<\|message\|>" + end), 1)
    every = F.regexp_extract_all(reply, F.lit(r"(?s)<\|message\|>" + end), 1)
    return F.when(F.size(final) > 0, F.element_at(final, 1)).when(F.size(every) > 0, F.element_at(every, -1)).otherwise(reply)


def question_stem(question: Column) -> Column:
    """A question without the options listed below it, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(question, r"(?s)\n\s*\(?[A-Ha-h][).:].*", ""), r"\s+", " "))


def scene_summary(captions: Column, shown: int = 4) -> Column:
    """The first captions of a scene, bars between them."""
    return F.array_join(F.slice(captions, 1, shown), " | ")
