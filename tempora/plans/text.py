"""Parsing, lexical memory and stub-embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions import text as tx
from tempora.sources.tables import TIMELINE_SQL, captions, table, timeline

OPTIONS = ("A. red", "B. blue", "C. green", "D. yellow")
NUMBERS = ("A. 3", "B. 5", "C. 6", "D. 7")


def _options(values=OPTIONS):
    return F.array(*[F.lit(v) for v in values])


def stub_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by slot of the stub embedding: counted where they are, none collected."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("token"))
    slot = (F.conv(F.right(F.md5("token"), F.lit(2)), 16, 10).cast("long")).alias("slot")
    counts = d.select("doc_id", slot).groupBy("doc_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "slot", F.round(F.col("n") / norm, 6).alias("weight"))


def stub_retrieval(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """Each conversation's turns nearest to its first, by stub embedding."""
    c = captions(spark, sf_dir).select("video_id", "frame_index", F.explode(F.regexp_extract_all(F.lower("caption"), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("token"))
    n = c.groupBy("video_id", "frame_index", F.conv(F.right(F.md5("token"), F.lit(2)), 16, 10).cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    norms = n.groupBy("video_id", "frame_index").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    q = n.where("frame_index = 0").select("video_id", "slot", F.col("n").alias("qn"))
    qnorm = norms.where("frame_index = 0").select("video_id", F.col("norm").alias("qnorm"))
    dots = n.join(q, ["video_id", "slot"]).groupBy("video_id", "frame_index").agg(F.sum(F.col("n") * F.col("qn")).alias("dot"))
    s = dots.join(norms, ["video_id", "frame_index"]).join(qnorm, "video_id").withColumn("score", F.round(F.col("dot") / F.col("norm") / F.col("qnorm"), 6))
    order = Window.partitionBy("video_id").orderBy(F.desc("score"), "frame_index")
    return s.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("video_id", "frame_index", "score", "rank")


def entity_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty most frequent entities of each conversation's role, first seen first of equals."""
    c = captions(spark, sf_dir).withColumn("video_id", F.col("video_id") % 20)
    e = c.select("video_id", (F.col("frame_index")).alias("frame_index"), F.posexplode(tx.entities(F.col("caption"))).alias("pos", "entity"))
    g = e.groupBy("video_id", "entity").agg(F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"))
    order = Window.partitionBy("video_id").orderBy(F.desc("n"), "first_frame", "entity")
    return g.withColumn("rank", F.row_number().over(order)).where("rank <= 40").select("video_id", "entity", "n", "first_frame", "last_frame", "rank")


def entity_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captions(spark, sf_dir)
    e = c.select("video_id", "frame_index", F.explode(F.array_distinct(tx.entities(F.col("caption")))).alias("entity"))
    return e.groupBy("video_id", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list("frame_index")), lambda x: x.cast("string")), ",").alias("postings"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events as questions that name one or two clocks (which begin anew after 5,900 units: minutes have two digits)."""
    tl = timeline(spark, sf_dir).withColumn("dur", F.max("t").over(Window.partitionBy("video_id")))
    s = F.floor(F.col("t") % 5900).cast("long")
    first, second = tx.clock(F.col("t") % 5900), tx.clock(F.col("t") % 5900 + 35)
    q = F.when(s % 3 == 0, F.concat(F.lit("What happens from "), first, F.lit("-"), second, F.lit("?"))).when(s % 3 == 1, F.concat(F.lit("What is seen at "), first, F.lit("?"))).otherwise(F.lit("What is it?"))
    return tl.select("video_id", "event_id", "t", (F.col("dur") / 2).alias("dur"), q.alias("question"))


def parse_clock_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir).withColumn("x", tx.stated_interval(F.col("question"), F.col("dur")))
    return a.select("event_id", F.round("x.lo", 6).alias("lo"), F.round("x.hi", 6).alias("hi"))


def anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _asked(spark, sf_dir).withColumn("x", tx.anchor_window(F.col("question"), F.col("dur")))
    return a.select("event_id", "x.lo", "x.hi")


def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).select("event_id", tx.clock(F.col("t")).alias("clock"))


def parse_time_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    tl = timeline(spark, sf_dir)
    end = F.when(F.col("event_id") % 4 == 0, F.lit("none")).otherwise(tx.clock(F.col("t") + F.when(F.col("event_id") % 4 == 1, -50).otherwise(20) + 50))
    ref = F.when(F.col("event_id") % 7 == 0, F.lit("0105")).otherwise(F.concat(tx.clock(F.col("t") + 40), F.lit("-"), end))
    return tl.select("event_id", tx.time_reference(ref).alias("x")).select("event_id", "x.lo", "x.hi")


def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field of each event's properties: plain, fenced, and cut off behind a quoted letter."""
    e = table(spark, sf_dir, "events")
    fenced = F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))
    cut = F.concat(F.lit('{"k": "'), F.substring("event_type", 1, 1), F.lit('", "rest'))
    reply = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, fenced).otherwise(cut)
    return e.select("event_id", tx.json_field(reply, "k").alias("k"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    letter = F.char(F.col("event_id") % 5 + 65)
    kinds = (F.concat(F.lit("("), letter, F.lit(")")), F.concat(F.lit("<think>maybe A</think>\n"), letter), F.concat(F.lit("Long words first.\nfinal_answer: "), letter), F.lit("It looks blue, then green to me"), F.lit(""), F.concat(F.lit("None of these can be told\nThe answer is "), letter))
    reply = F.lit(None).cast("string")
    for i, kind in enumerate(kinds):
        reply = F.when(F.col("event_id") % 6 == i, kind).otherwise(reply)
    return e.select("event_id", reply.alias("reply"))


def mcq_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("event_id", tx.normalize_choice(F.col("reply"), _options()).alias("letter"))


def mcq_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir).withColumn("letter", tx.normalize_choice(F.col("reply"), _options()))
    return r.select("event_id", tx.mcq_correct(F.col("letter"), F.lit("c. green")).alias("correct"))


def options_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    words = F.slice(F.split("text", " "), 1, 3)
    return b.select("item_id", tx.format_options(F.concat(F.array(F.lit("A) first")), words)).alias("options"))


def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    forms = F.array(F.lit("(B)"), F.lit("green"), F.lit("A. red"), F.lit("  Yellow "), F.lit("E"), F.lit("none of them"))
    return e.select("event_id", tx.answer_letter(F.element_at(forms, (F.col("event_id") % 6 + 1).cast("int")), _options()).alias("letter"))


def cardinality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("How many times did they "), F.col("event_type"), F.lit("?"))).otherwise(F.lit("Somehow manyfold?"))
    options = F.when(F.col("event_id") % 3 == 0, _options(NUMBERS)).otherwise(_options(("A. 3 minutes", "B. 5", "C. $6", "D. 7 minutes")))
    return e.select("event_id", tx.is_cardinality(q, options).alias("counts"), F.size(tx.option_quantities(options)).alias("quantities"))


def ledger_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    listed = F.array_join(F.transform(lines, lambda x, i: F.when(i % 2 == 0, F.concat((i % 90 + 1).cast("string"), F.lit(". "), x)).otherwise(x)), "\n")
    return d.select("doc_id", F.size(tx.ledger_items(F.when(F.col("doc_id") % 5 == 0, "None.").otherwise(listed))).alias("items"))


def route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.route(F.col("text")).alias("route"), tx.retrieval_mode(F.col("text")).alias("mode"))


def numbered_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with four numbered captions, or too few, taken apart."""
    c = captions(spark, sf_dir)
    line = lambda i: F.concat(F.lit(f"{i}. "), F.col("role"), F.lit(f" {i}"))
    reply = F.concat_ws("\n", F.lit("Sure:"), line(1), F.lit("goes on"), line(2), F.when(F.col("frame_index") % 2 == 0, line(3)), F.concat(F.lit("Frame 4: "), F.col("role")))
    return c.select("video_id", "frame_index", F.array_join(tx.numbered_captions(reply, 4), "|").alias("captions"))


def visual_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cost = tx.token_cost(F.col("p_size") * 28, F.col("p_size") * 14)
    return p.groupBy(F.col("p_brand").alias("brand")).agg(F.sum(cost).alias("tokens"), F.count(F.lit(1)).alias("frames"))


def parse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("look at ["), F.col("event_id") % 50, F.lit("-"), F.col("event_id") % 70, F.lit("] or [3, 9]"))).otherwise(F.concat(F.lit("frame ["), F.col("event_id") % 70, F.lit("]")))
    return e.select("event_id", F.explode(tx.ranges(reply, F.lit(60))).alias("x")).select("event_id", "x.lo", "x.hi")


def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("/runs/lvb/mem"), F.col("s_suppkey") % 7, F.lit("/Model"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("_seed"), F.col("s_suppkey") % 5)).otherwise(""), F.lit("/val.json"))
    return n.select("s_suppkey", tx.run_key(path).alias("k"), tx.slug(F.col("s_name")).alias("slug")).select("s_suppkey", "k.dataset", "k.memory", "k.model", "k.seed", "slug")


def prompt_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cut = tx.middle_cut(F.col("text"), 1000)
    return d.select("doc_id", F.left(F.md5("text"), F.lit(8)).alias("prompt"), F.left(F.sha2(cut, 256), F.lit(16)).alias("cut"), F.length(cut).alias("chars"))


QUERIES = {f.__name__: f for f in (stub_embedding, stub_retrieval, entity_top40, entity_postings, parse_clock_interval, anchor_windows, clock_format, parse_time_reference, json_field_extract, mcq_normalize, mcq_eval, options_format, answer_letters, cardinality_gate, ledger_parse, route_question, numbered_captions, visual_token_cost, parse_ranges, run_keys, prompt_digests)}

_SLOT = "CAST(concat('0x', right(md5(token), 2)) AS INT)"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_ENT = f"ent AS (SELECT conv_id AS video_id, turn AS frame_index, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z\\-'']+')) AS entity FROM conversations), kept AS (SELECT * FROM ent WHERE length(entity) >= 4 AND entity NOT IN ({_STOPS}))"
_S = "CAST(floor(t) AS BIGINT)"
_ASKED = f"a0 AS (SELECT *, max(t) OVER (PARTITION BY video_id) / 2 AS dur, CAST(floor(t % 5900) AS BIGINT) AS s FROM tl), asked AS (SELECT event_id, dur, s, CASE WHEN s % 3 = 0 THEN s WHEN s % 3 = 1 THEN s END AS c0, CASE WHEN s % 3 = 0 THEN s + 35 WHEN s % 3 = 1 THEN s END AS c1 FROM a0)"
_LETTER = "CASE event_id % 6 WHEN 3 THEN 'C' WHEN 4 THEN '?' ELSE CASE WHEN event_id % 5 < 4 THEN chr(CAST(event_id % 5 + 65 AS INT)) ELSE '?' END END"
ORACLE = {
    "stub_embedding": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM documents), c AS (SELECT doc_id, CAST({_SLOT} AS BIGINT) AS slot, count(*) AS n FROM t GROUP BY 1, 2) SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c",
    "stub_retrieval": f"""WITH t AS (SELECT conv_id AS video_id, turn AS frame_index, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM conversations), n AS (SELECT video_id, frame_index, {_SLOT} AS slot, count(*) AS n FROM t GROUP BY 1, 2, 3), m AS (SELECT video_id, frame_index, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1, 2),
d AS (SELECT n.video_id, n.frame_index, sum(n.n * q.n) AS dot FROM n JOIN n q ON q.video_id = n.video_id AND q.slot = n.slot AND q.frame_index = 0 GROUP BY 1, 2), s AS (SELECT d.video_id, d.frame_index, round(dot / m.norm / q.norm, 6) AS score FROM d JOIN m ON m.video_id = d.video_id AND m.frame_index = d.frame_index JOIN m q ON q.video_id = d.video_id AND q.frame_index = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 3""",
    "entity_top40": f"WITH {_ENT}, g AS (SELECT video_id % 20 AS video_id, entity, count(*) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM kept GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first_frame, entity) AS INT) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first_frame, entity) <= 40",
    "entity_postings": f"WITH {_ENT}, u AS (SELECT DISTINCT * FROM kept) SELECT video_id, entity, string_agg(frame_index::VARCHAR, ',' ORDER BY frame_index) AS postings FROM u GROUP BY 1, 2",
    "parse_clock_interval": f"""WITH {TIMELINE_SQL}, {_ASKED}, b AS (SELECT event_id, dur, c0::DOUBLE AS low, CASE WHEN dur > 0 THEN least(c1::DOUBLE, dur) ELSE c1::DOUBLE END AS high FROM asked),
c AS (SELECT event_id, dur, low, greatest(0.0, CASE WHEN high - low < 1e-6 THEN low - 6 ELSE low END) AS lo, CASE WHEN high - low < 1e-6 THEN low + 6 ELSE high END AS h FROM b), d AS (SELECT *, CASE WHEN dur > 0 THEN least(h, dur) ELSE h END AS hi FROM c)
SELECT event_id, CASE WHEN NOT (dur > 0 AND low > dur) AND hi > lo THEN round(lo, 6) END AS lo, CASE WHEN NOT (dur > 0 AND low > dur) AND hi > lo THEN round(hi, 6) END AS hi FROM d""",
    "anchor_windows": f"WITH {TIMELINE_SQL}, {_ASKED}, c AS (SELECT event_id, unnest([c0, c1]) AS x, dur FROM asked), g AS (SELECT event_id, min(x) AS lo, max(x) AS hi FROM c WHERE x IS NOT NULL AND (NOT dur > 0 OR x <= dur + 1) GROUP BY 1) SELECT a.event_id, CASE WHEN lo IS NOT NULL THEN greatest(0.0, lo - 6)::DOUBLE END AS lo, (hi + 6)::DOUBLE AS hi FROM asked a LEFT JOIN g USING (event_id)",
    "clock_format": f"WITH {TIMELINE_SQL} SELECT event_id, printf('%d:%02d', {_S} // 60, {_S} % 60) AS clock FROM tl",
    "parse_time_reference": f"""WITH {TIMELINE_SQL}, x AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(t + 40) AS BIGINT) END AS lo, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(t + CASE WHEN event_id % 4 = 1 THEN -50 ELSE 20 END + 50) AS BIGINT) END AS e FROM tl) SELECT event_id, lo, CASE WHEN lo IS NOT NULL THEN greatest(lo, coalesce(e, lo)) END AS hi FROM x""",
    "json_field_extract": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN substr(event_type, 1, 1) ELSE json_extract_string(props, '$.k') END AS k FROM events",
    "mcq_normalize": f"SELECT event_id, {_LETTER} AS letter FROM events",
    "mcq_eval": f"SELECT event_id, {_LETTER} = 'C' AS correct FROM events",
    "options_format": "SELECT item_id, 'A) first' || chr(10) || array_to_string(list_transform(string_split(text, ' ')[1:3], lambda w, i: CASE WHEN regexp_matches(w, '^[A-Za-z][\\.\\):]') THEN w ELSE chr(CAST(65 + i AS INT)) || '. ' || w END), chr(10)) AS options FROM benchmark",
    "answer_letters": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN 'D' END AS letter FROM events",
    "cardinality_gate": "SELECT event_id, event_id % 6 = 0 AS counts, CAST(CASE WHEN event_id % 3 = 0 THEN 4 ELSE 2 END AS INT) AS quantities FROM events",
    "ledger_parse": """WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 2 = 1 THEN ((i - 1) % 90 + 1) || '. ' || x ELSE x END), chr(10)) AS t FROM documents),
m AS (SELECT doc_id, len(list_filter(string_split_regex(trim(t), '\\r?\\n'), lambda x: regexp_matches(x, '^\\s*(?:\\d{1,2}\\s*[.)\\]]|[-*•])\\s*\\S'))) AS n FROM l) SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 OR n > 60 THEN 0 ELSE n END AS INT) AS items FROM m""",
    "route_question": "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'why|how|reason|cause|overall|summar|purpose') THEN 'text' ELSE 'fusion' END AS route, CASE WHEN regexp_matches(lower(text), 'before|after|then|next|following|prior|earlier|later') THEN 'NEIGHBOR' WHEN regexp_matches(lower(text), 'overall|summar|main topic|throughout|how many times|in total') THEN 'VIDEO' ELSE 'EVENT' END AS mode FROM documents",
    "numbered_captions": "SELECT conv_id AS video_id, turn AS frame_index, CASE WHEN turn % 2 = 0 THEN role || ' 1 goes on|' || role || ' 2|' || role || ' 3|' || role END AS captions FROM conversations",
    "visual_token_cost": "SELECT p_brand AS brand, CAST(sum(greatest(1, p_size) * greatest(1, p_size * 14 // 28)) AS BIGINT) AS tokens, count(*) AS frames FROM part GROUP BY 1",
    "parse_ranges": "SELECT event_id, event_id % 50 AS lo, greatest(event_id % 50, least(59, event_id % 70)) AS hi FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 3, 9 FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, greatest(0, event_id % 70 - 2), least(59, event_id % 70 + 2) FROM events WHERE event_id % 2 = 1",
    "run_keys": "SELECT s_suppkey, 'lvb' AS dataset, 'mem' || s_suppkey % 7 AS memory, 'Model' || s_nationkey AS model, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 ELSE 42 END AS INT) AS seed, regexp_replace(s_name, '[^\\w\\-.]', '_', 'g') AS slug FROM supplier",
    "prompt_digests": "WITH c AS (SELECT doc_id, text, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 493) || chr(10) || '...[cut]...' || chr(10) || right(text, 493) END AS cut FROM documents) SELECT doc_id, left(md5(text), 8) AS prompt, left(sha256(cut), 16) AS cut, CAST(length(cut) AS INT) AS chars FROM c",
}
