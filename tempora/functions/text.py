"""Tolerant parsing of questions, replies and references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no entities (fixed values).
STOP_WORDS = (
    "the", "a", "an", "is", "are", "in", "on", "at", "of", "and", "with", "to",
    "for", "from", "his", "her", "their", "its", "this", "that", "there", "as",
    "by", "into", "over", "near", "while", "man", "woman", "person", "people",
    "video", "frame", "camera", "shot", "scene", "background", "foreground",
)
#: Cues of question routing (fixed values).
REASONING_CUES = ("why", "how", "reason", "cause", "overall", "summar", "purpose")
NEIGHBOR_CUES = ("before", "after", "then", "next", "following", "prior", "earlier", "later")
GLOBAL_CUES = ("overall", "summar", "main topic", "throughout", "how many times", "in total")
#: Phrases and forms of counting questions (fixed values).
CARDINALITY = r"(?i)\bhow many\b|\bhow much\b|\bnumber of\b|\bhow often\b|\bhow long\b"
BARE_QUANTITY = r"^\$?\s*(\d+(?:\.\d+)?)\s*%?$"
LEDGER_LINE = r"^\s*(?:\d{1,2}\s*[.)\]]|[-*•])\s*\S"
CLOCK = r"(?<!\d)(\d{1,2}:[0-5]\d(?::[0-5]\d)?)(?!\d)"
ANSWER = r"(?i)(?:final[_\s-]?answer|answer)\s*(?:is|=|:)?\s*\(?([A-Za-z])\b"
ONLY_LETTER = r"^\(?\s*([A-Za-z])\s*[\)\.:]?\s*$"

POINT_PAD = 6.0
MOST_LEDGER_ITEMS = 60


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _last(matches: Column) -> Column:
    return F.when(F.size(matches) > 0, F.element_at(matches, -1))


def json_field(text: Column, field: str, default: str = "") -> Column:
    """A field of a reply that may be JSON, hold fenced JSON, or be cut off.

    The last quoted value wins over a last bare letter. A value that is no text
    is given as JSON text.
    """
    path = f"$.{field}"
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)\s*```"), 1)
    parsed = F.filter(F.transform(fenced, lambda x: F.get_json_object(x, path)), lambda x: x.isNotNull())
    quoted = _last(F.regexp_extract_all(text, F.lit(rf'"{field}"\s*:\s*"([^"]*)"'), 1))
    bare = _last(F.regexp_extract_all(text, F.lit(rf'"{field}"\s*:\s*([A-Za-z])\b'), 1))
    first = F.when(F.size(parsed) > 0, F.element_at(parsed, 1))
    return F.coalesce(F.get_json_object(text, path), first, quoted, bare, F.lit(default))


def seconds(clock: Column) -> Column:
    """``m:ss`` or ``h:mm:ss`` in seconds."""
    parts = F.split(clock, ":")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))


def time_reference(text: Column) -> Column:
    """``start-end`` clocks as a struct of seconds; a missing or earlier end is the start; null without a range."""
    sides = F.split(F.trim(text), "-", 2)
    clock = r"^\s*\d+:\d{1,2}(:\d{1,2})?\s*$"
    start, end = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    lo = F.when(start.rlike(clock), seconds(F.trim(start)))
    hi = F.when(end.rlike(clock), seconds(F.trim(end)))
    return F.when(lo.isNotNull() & (F.size(sides) == 2), F.struct(lo.alias("lo"), F.greatest(lo, F.coalesce(hi, lo)).alias("hi")))


def stated_interval(question: Column, duration: Column) -> Column:
    """Earliest to latest clock that a question names, a lone one padded, within the duration; else null."""
    times = F.transform(F.regexp_extract_all(question, F.lit(CLOCK), 1), lambda c: seconds(c).cast("double"))
    low, high = F.array_min(times), F.array_max(times)
    known = F.coalesce(duration, F.lit(0.0)) > 0
    high = F.when(known, F.least(high, duration)).otherwise(high)
    point = high - low < 1e-6
    lo = F.greatest(F.lit(0.0), F.when(point, low - POINT_PAD).otherwise(low))
    hi = F.when(point, low + POINT_PAD).otherwise(high)
    hi = F.when(known, F.least(hi, duration)).otherwise(hi)
    fits = (F.size(times) > 0) & ~(known & (low > duration)) & (hi > lo)
    return F.when(fits, F.struct(lo.alias("lo"), hi.alias("hi")))


def anchor_window(question: Column, duration: Column) -> Column:
    """Window around all clocks up to the duration and one second, padded; its end is not clipped."""
    times = F.transform(F.regexp_extract_all(question, F.lit(CLOCK), 1), lambda c: seconds(c).cast("double"))
    known = F.coalesce(duration, F.lit(0.0)) > 0
    times = F.filter(times, lambda t: ~known | (t <= duration + 1))
    return F.when(F.size(times) > 0, F.struct(F.greatest(F.lit(0.0), F.array_min(times) - POINT_PAD).alias("lo"), (F.array_max(times) + POINT_PAD).alias("hi")))


def survey_times(reply: Column, duration: Column) -> Column:
    """Clocks of a reply in seconds: distinct, in order, none beyond a known duration."""
    times = F.transform(F.regexp_extract_all(reply, F.lit(CLOCK), 1), lambda c: seconds(c).cast("double"))
    return F.array_distinct(F.filter(times, lambda t: ~(F.coalesce(duration, F.lit(0.0)) > 0) | (t <= duration)))


def clock(t: Column) -> Column:
    whole = F.floor(t).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60)


def _letter(s: Column, options: Column) -> Column:
    found = F.upper(_none_if_empty(s))
    return F.when(F.ascii(found) - 65 < F.greatest(F.lit(1), F.size(options)), found)


def normalize_choice(reply: Column, options: Column) -> Column:
    """The option letter that a free-form reply means, or ``?``.

    In order: the reply is a letter; one of its last five lines, the latest
    first, is a letter or states an answer; the reply states an answer
    anywhere; it holds an option's text (the last one named); it begins with a letter.
    """
    clean = F.trim(F.regexp_replace(reply, r"(?is)<think>.*?</think>", " "))
    whole = F.when(F.length(clean) <= 8, _letter(F.regexp_extract(clean, ONLY_LETTER, 1), options))
    lines = F.filter(F.transform(F.split(clean, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    late = F.reverse(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 4), 5))
    told = F.filter(F.transform(late, lambda x: F.coalesce(_letter(F.regexp_extract(x, ONLY_LETTER, 1), options), _letter(F.regexp_extract(x, ANSWER, 1), options))), lambda x: x.isNotNull())
    by_line = F.when(F.size(told) > 0, F.element_at(told, 1))
    anywhere = _letter(F.regexp_extract(clean, ANSWER, 1), options)

    def place(option: Column, i: Column) -> Column:
        body = F.lower(F.trim(F.regexp_replace(option, r"^[A-Za-z][\.\):]\s*", "")))
        back = F.locate_last(F.lower(clean), body) if hasattr(F, "locate_last") else F.length(clean) - F.instr(F.reverse(F.lower(clean)), F.reverse(body)) - F.length(body) + 1
        there = F.instr(F.lower(clean), body) > 0
        return F.struct(F.when((F.length(body) >= 3) & there, back).otherwise(-1).alias("at"), (-i).alias("order"))

    named = F.array_max(F.transform(options, place))
    by_text = F.when(named["at"] >= 0, F.char(F.lit(65) - named["order"]))
    begins = _letter(F.regexp_extract(clean, r"^\(?\s*([A-Za-z])\s*[\)\.:\-]", 1), options)
    return F.coalesce(F.when(F.coalesce(clean, F.lit("")) == "", F.lit("?")), whole, by_line, anywhere, by_text, begins, F.lit("?"))


def mcq_correct(prediction: Column, target: Column) -> Column:
    """Equal first letters, or equal texts where they begin with none; null predictions are wrong."""
    def key(c: Column) -> Column:
        up = F.upper(F.trim(c))
        return F.when(F.substring(up, 1, 1).rlike(r"\p{L}"), F.substring(up, 1, 1)).otherwise(up)

    return F.coalesce(key(prediction) == key(target), F.lit(False))


def format_options(options: Column) -> Column:
    """Options one a line, lettered where they are not yet."""
    return F.array_join(F.transform(options, lambda o, i: F.when(o.rlike(r"^[A-Za-z][\.\):]\s*"), o).otherwise(F.concat(F.char(i + 65), F.lit(". "), o))), "\n")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def answer_letter(answer: Column, options: Column) -> Column:
    """Letter of an answer given as a letter, a decorated letter, or an option's text with or without its letter."""
    s = F.trim(answer)
    leading = F.upper(_none_if_empty(F.regexp_extract(s, r"^\(?\s*([A-Ha-h])\s*[).:\-]?", 1)))
    leading = F.when(F.ascii(leading) - 65 < F.size(options), leading)
    short = (F.length(s) <= 3) | (F.size(F.split(s, r"\s+")) <= 1)
    plain = F.array_position(F.transform(options, squeeze), squeeze(s))
    bare = F.array_position(F.transform(options, lambda o: squeeze(F.regexp_replace(o, r"^\(?[A-Ha-h]\)?[).:\-]?\s*", ""))), squeeze(s))
    by_text = F.when(plain > 0, F.char(plain + 64)).when(bare > 0, F.char(bare + 64))
    return F.coalesce(F.when(short, leading), by_text, leading)


def option_quantities(options: Column) -> Column:
    bodies = F.transform(options, lambda o: F.trim(F.regexp_replace(o, r"^\s*[A-Da-d]\s*[.)]\s*", "")))
    return F.transform(F.filter(bodies, lambda b: b.rlike(BARE_QUANTITY)), lambda b: F.regexp_extract(b, BARE_QUANTITY, 1).cast("double"))


def is_cardinality(question: Column, options: Column) -> Column:
    return F.coalesce(question.rlike(CARDINALITY) & (F.size(option_quantities(options)) >= 3), F.lit(False))


def ledger_items(reply: Column) -> Column:
    """Listed lines of a reply; none for an abstention, no list, or one too long."""
    text = F.trim(reply)
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(LEDGER_LINE)), lambda x: F.trim(x))
    usable = (F.coalesce(text, F.lit("")) != "") & ~text.rlike(r"(?i)^\W*NONE\W*$") & (F.size(lines) <= MOST_LEDGER_ITEMS)
    return F.when(usable, lines).otherwise(F.array().cast("array<string>"))


def route(question: Column) -> Column:
    """``text`` for reasoning cues, else ``fusion``; cues match inside words too."""
    q = F.lower(question)
    return F.when(q.rlike("|".join(REASONING_CUES)), "text").otherwise("fusion")


def retrieval_mode(question: Column) -> Column:
    q = F.lower(question)
    return F.when(q.rlike("|".join(NEIGHBOR_CUES)), "NEIGHBOR").when(q.rlike("|".join(GLOBAL_CUES)), "VIDEO").otherwise("EVENT")


def entities(caption: Column) -> Column:
    """Entity tokens in order: words of four letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(caption), F.lit(r"([A-Za-z][A-Za-z\-']+)"), 1)
    return F.filter(found, lambda x: (F.length(x) >= 4) & ~x.isin(*STOP_WORDS))


def ranges(reply: Column, n: Column) -> Column:
    """Frame ranges of a reply, clamped to the frames.

    Its JSON field ``ranges`` if it holds any; else pairs in brackets (four at
    most), else single numbers widened by two (four at most).
    """
    last = n.cast("long") - 1
    pairs = F.slice(F.regexp_extract_all(reply, F.lit(r"\[(\d+\s*[-,]\s*\d+)\]"), 1), 1, 4)
    singles = F.slice(F.regexp_extract_all(reply, F.lit(r"\[(\d+)\]"), 1), 1, 4)
    raw = json_field(reply, "ranges")
    listed = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<array<long>>")
    listed = F.filter(listed, lambda x: (F.size(x) == 2) & x[0].isNotNull() & x[1].isNotNull())

    def of(lo: Column, hi: Column) -> Column:
        lo = F.greatest(F.lit(0).cast("long"), F.least(lo.cast("long"), last))
        return F.struct(lo.alias("lo"), F.greatest(lo, F.least(hi.cast("long"), last)).alias("hi"))

    def of_pair(p: Column) -> Column:
        sides = F.split(p, r"\s*[-,]\s*")
        return of(F.element_at(sides, 1), F.element_at(sides, 2))

    def of_single(x: Column) -> Column:
        return F.struct(F.greatest(F.lit(0).cast("long"), x.cast("long") - 2).alias("lo"), F.least(last, x.cast("long") + 2).alias("hi"))

    told = F.transform(listed, lambda x: of(x[0], x[1]))
    return F.when(F.size(listed) > 0, told).when(F.size(pairs) > 0, F.transform(pairs, of_pair)).otherwise(F.transform(singles, of_single))


def numbered_captions(reply: Column, n: int) -> Column:
    """Exactly ``n`` captions of a numbered reply, continued lines joined; else null."""
    text = F.regexp_replace(reply, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", " ")
    number = r"^\s*(?:[Ff]rame\s*)?(\d{1,3})\s*[.):]\s*(.*)$"
    found = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    zero = F.struct(found.alias("found"), F.lit(None).cast("int").alias("last"))

    def step(a: Column, line: Column) -> Column:
        at = F.when(line.rlike(number), F.regexp_extract(line, number, 1).cast("int"))
        fresh = at.between(1, n) & ~F.map_contains_key(a["found"], F.coalesce(at, F.lit(-1)))
        added = F.map_concat(a["found"], F.map_from_arrays(F.array(F.coalesce(at, F.lit(-1))), F.array(F.trim(F.regexp_extract(line, number, 2)))))
        longer = F.transform_values(a["found"], lambda k, v: F.when(k == a["last"], F.concat(v, F.lit(" "), F.trim(line))).otherwise(v))
        more = at.isNull() & a["last"].isNotNull() & (F.trim(line) != "")
        return F.struct(
            F.when(F.coalesce(fresh, F.lit(False)), added).when(more, longer).otherwise(a["found"]).alias("found"),
            F.when(at.isNull(), a["last"]).when(F.coalesce(fresh, F.lit(False)), at).otherwise(F.lit(None).cast("int")).alias("last"),
        )

    done = F.aggregate(F.split(text, r"\r?\n"), zero, step, lambda a: a["found"])
    return F.when(F.size(done) == n, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(done, i)))


def token_cost(width: Column, height: Column) -> Column:
    return (F.greatest(F.lit(1), F.floor(width / 28)) * F.greatest(F.lit(1), F.floor(height / 28))).cast("long")


def middle_cut(text: Column, most: int, marker: str = "\n...[cut]...\n") -> Column:
    half = (most - len(marker)) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half))))


def run_key(path: Column) -> Column:
    """``dataset, memory, model, seed`` of a result path; the seed is 42 where the path names none."""
    form = r"([^/]+)/([^/]+)/([^/]+?)(?:_seed(\d+))?/(?:val|test)\.json$"
    part = lambda i: F.regexp_extract(path, form, i)
    return F.struct(part(1).alias("dataset"), part(2).alias("memory"), part(3).alias("model"), F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(42)).alias("seed"))


def slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\w\-.]", "_")
