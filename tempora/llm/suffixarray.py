"""Exact removal of long repeats by suffix arrays built with linear grouping.

Which bytes lie in a string of ``length`` bytes that also starts elsewhere?

1. Every possible start of such a string picks a coarse anchor: the place of the
   least hash among those whose ``GRAM`` bytes lie in the string. Equal strings
   pick equal anchors, so a string can only repeat if its anchor's gram is
   found in two places. Few do, and only their documents and starts go on.
2. These starts pick an anchor again, within ``window`` bytes. All strings of one
   anchor share ``length + 1 - window`` bytes, whose hash is the anchor's class;
   its block is the class with ``window - 1`` bytes on either side. Equal blocks
   are one from here on, so copies cost nothing, and their strings all repeat.
3. Where a class has different blocks, their edges around one symbol for the
   shared middle, as far as another block has them too, form a text, many
   classes to a text, whose suffix array is built by linear grouping
   (``suffix_array``). A string repeats if a neighbour in it agrees over
   ``window`` symbols.
4. A class with very many different blocks (a passage in very many documents)
   is split first: strings with many bytes before the middle go by those
   bytes, the others by the bytes behind it. Either part is a class with a
   longer middle and half the window, and is split again if it is still hot.
5. The repeated strings return to their documents, which lose the bytes.

A document is known by two hashes of its text (95 bits), so copies are one
document that repeats; a block by those of its class and its sides (128 bits).
What later steps read again is checkpointed, so anchors and blocks are computed once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tempora.llm.common import durable, release

LENGTH = 400
WINDOW = 64  # at most
GRAM = 64
SECOND_SEED = 77
MOST_BLOCKS = 2048  # different blocks of a class that are ordered together
TEXT_SYMBOLS = 6_000  # of a text that many classes share; what fits a cache is ordered faster


# -- the suffix array ----------------------------------------------------------


def suffix_array(text: np.ndarray) -> list[int]:
    """Suffix array of integer symbols, in linear time but for sorting small groups.

    Suffixes start in groups of equal first symbols, in symbol order. Groups are
    taken in descending order. The previous smaller suffix of each member (found
    by following the pointers of members already done) belongs to a lower group;
    it is moved right behind that group, farther for every further
    member it precedes. Then all suffixes of a group begin with the same longest
    Lyndon prefix, and one ascending pass that follows the same pointers emits
    each group's order.
    """
    n = len(text)
    if not n:
        return []
    order = np.argsort(text, kind="stable")
    symbols = text[order]
    head = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    sizes = np.diff(np.concatenate([head, [n]]))
    place = order.tolist()  # suffixes, group by group
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    at = where.tolist()  # a suffix's index in place
    group = np.repeat(head, sizes)[where].tolist()  # the index where its group begins
    size = [0] * n
    for h, s in zip(head.tolist(), sizes.tolist(), strict=True):
        size[h] = s
    smaller = [-1] * n

    top = n - 1
    while top >= 0:
        first = group[place[top]]
        if first == top:  # a single member moves a single suffix
            i = place[top]
            top -= 1
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                g = group[j]
                k = size[g] - 1
                if k:
                    last, p = g + k, at[j]
                    other = place[last]
                    place[last], place[p] = j, other
                    at[j], at[other] = last, p
                    size[g], size[last], group[j] = k, 1, last
            continue
        members = place[first : top + 1]
        members.sort()
        count: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        top = first - 1
        by_count: dict[int, list[int]] = defaultdict(list)
        for j, c in count.items():
            by_count[c].append(j)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[c]:
                g = group[j]
                k = moved.get(g, 0)
                last, p = g + size[g] - 1 - k, at[j]
                other = place[last]
                place[last], place[p] = j, other
                at[j], at[other] = last, p
                moved[g] = k + 1
            for g, k in moved.items():
                start = g + size[g] - k
                if start == g:
                    continue
                for p in range(start, start + k):
                    group[place[p]] = start
                size[g] -= k
                size[start] = k

    out = [-1] * n
    done = [False] * n
    nearest = list(range(n))  # where a group's next suffix goes, by its beginning

    for i in range(-1, n):
        j = out[i] - 1 if i >= 0 else n - 1
        while j >= 0 and not done[j]:
            g = group[j]
            p = nearest[g]
            out[p] = j
            nearest[g] = p + 1
            done[j] = True
            j = smaller[j]
    return out


# -- anchors, classes and blocks -----------------------------------------------


def _place_hashes(data: bytes) -> np.ndarray:
    """A hash of the eight bytes at each place, above the place itself."""
    n = len(data)
    h = np.ndarray((n,), "<u8", data + bytes(8), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(n, dtype=np.uint64)
    return h


def _changes(ascending: np.ndarray) -> np.ndarray:
    """Distinct values of an ascending array."""
    return ascending[np.concatenate([[True], ascending[1:] != ascending[:-1]])] if len(ascending) else ascending


def _least(hashes: np.ndarray, span: int, starts: int) -> np.ndarray:
    """For each start the place of the least hash in the ``span`` places behind it, the first of equals."""
    least, have = hashes[: starts + span - 1], 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def coarse_anchors(data: bytes, length: int, gram: int) -> np.ndarray:
    """The coarse anchor of each start of a string of ``length`` bytes."""
    starts = len(data) - length + 1
    return _least(_place_hashes(data), length - gram + 1, starts) if starts > 0 else np.zeros(0, np.int64)


def anchors(data: bytes, length: int, window: int, gram: int, repeated: set[int]) -> np.ndarray:
    """Anchors of the starts whose coarse anchor is one of ``repeated``, ascending."""
    starts = len(data) - length + 1
    if starts <= 0:
        return np.zeros(0, np.int64)
    hashes = _place_hashes(data)
    live = np.zeros(len(data), bool)
    live[list(repeated)] = True
    return _changes(_least(hashes, window, starts)[live[_least(hashes, length - gram + 1, starts)]])


def _edges(data: bytes, q: int, length: int, window: int) -> tuple[bytes, bytes]:
    behind = q + length + 1 - window
    return data[max(0, q - window + 1) : q], data[behind : q + length]


def _shared(sides: list[bytes], order: str) -> list[int]:
    """For each side the most bytes next to the middle (``order`` says where it lies) that another one has too."""
    numbers = [int.from_bytes(x, order) for x in sides]  # the byte next to the middle is the lowest
    ranked = sorted(range(len(sides)), key=[x[::-1] if order == "big" else x for x in sides].__getitem__)
    most = [0] * len(sides)
    for i, j in zip(ranked, ranked[1:]):
        x = numbers[i] ^ numbers[j]
        n = min(len(sides[i]), len(sides[j]))
        if x:
            n = min(n, ((x & -x).bit_length() - 1) >> 3)
        most[i] = max(most[i], n)
        most[j] = n
    return most


def trimmed(blocks: list[tuple[bytes, bytes]], window: int) -> list[tuple[int, bytes, bytes]]:
    """Of the blocks (left, right) of one class: number and edges, as far as another block has the same; those too short for a string go.

    A string that another block has lies in what either side shares with it, so
    none that repeats is lost, and the suffix array orders nothing needless.
    """
    sides = zip(_shared([x[0] for x in blocks], "big"), _shared([x[1] for x in blocks], "little"), blocks, strict=True)
    return [(i, left[len(left) - n :], right[:m]) for i, (n, m, (left, right)) in enumerate(sides) if n + m >= window - 1]


def repeated_offsets(blocks: list[tuple[Hashable, bytes, bytes]], window: int) -> list[list[int]]:
    """For blocks (class, left, right): the offsets (bytes before the anchor) whose strings another block has."""
    classes = {c: 256 + i for i, c in enumerate(dict.fromkeys(b[0] for b in blocks))}
    parts, owner, offset, valid = [], [], [], []
    for i, (c, left, right) in enumerate(blocks):
        parts.append(np.concatenate([np.frombuffer(left, np.uint8).astype(np.int32), [classes[c]], np.frombuffer(right, np.uint8).astype(np.int32), [256 + len(classes) + i]]).astype(np.int32))
        n = len(parts[-1])
        o = len(left) - np.arange(n)
        owner.append(np.full(n, i))
        offset.append(o)
        valid.append((o >= 0) & (window - 1 - o <= len(right)))
    text, owner_, offset_, valid_ = (np.concatenate(x) for x in (parts, owner, offset, valid))
    order = np.array(suffix_array(text))
    above, below = order[:-1], order[1:]
    both = valid_[above] & valid_[below]
    above, below = above[both], below[both]
    repeats = np.zeros(len(text), bool)
    views = np.lib.stride_tricks.sliding_window_view(text, window) if len(text) >= window else None
    for s in range(0, len(above), 50_000):
        a, b = above[s : s + 50_000], below[s : s + 50_000]
        same = (views[a] == views[b]).all(axis=1)
        repeats[a[same]] = True
        repeats[b[same]] = True
    out: list[list[int]] = [[] for _ in blocks]
    for p in np.flatnonzero(repeats):
        out[owner_[p]].append(int(offset_[p]))
    return out


# -- the distributed operator --------------------------------------------------


def _slices(batch: pa.RecordBatch, rows: int = 256, most: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with so many rows and bytes of text at most, but one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = upto[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.encode() if x else b"" for x in batch.column("text").to_pylist()]


def _table(columns: list[list], spec: str) -> pa.RecordBatch:
    """A batch of columns; each is a list of arrays (put end to end) or of values."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(", "))])
    arrays = []
    for held, field in zip(columns, schema, strict=True):
        if field.type == pa.binary():
            arrays.append(pa.array(held, field.type))
        else:
            arrays.append(pa.array(np.concatenate(held).astype(field.type.to_pandas_dtype()) if held else np.zeros(0, field.type.to_pandas_dtype()), field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _mask(offsets: Iterable[int]) -> int:
    """Bits of a signed 64-bit number for the offsets."""
    bits = sum(1 << o for o in offsets)
    return bits - (1 << 64) if bits >> 63 else bits


def _hashes(parts: Iterator[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in parts], np.uint64).view(np.int64)


def _cut_texts(texts: pa.Array, tags: np.ndarray, found: pa.ListArray, whole: np.ndarray, length: int, window: int) -> tuple[pa.Array, np.ndarray]:
    """What stays of each text, and the number of runs removed: all texts end to end, in whole arrays.

    ``found`` has places with a bit for each start before them that repeats (those
    with another tag are another text's); of ``whole`` texts every start does.
    """
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = int(first[-1])
    data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    starts = np.zeros(total + 1, np.int8)
    spans = pc.list_flatten(found)
    if len(spans):
        text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
        masks = spans.field("mask").to_numpy(zero_copy_only=False).view(np.uint64)
        row, offset = np.nonzero((masks[:, None] >> np.arange(window, dtype=np.uint64)) & np.uint64(1))
        places = spans.field("q").to_numpy(zero_copy_only=False).astype(np.int64)
        own = places >> 32 == tags[text] >> 32
        at = (places & 0xFFFFFFFF)[row] - offset
        fits = (at >= 0) & (at <= sizes[text[row]] - length) & own[row]
        starts[first[text[row[fits]]] + at[fits]] = 1
    change = starts.astype(np.int32)
    change[length:] -= starts[: max(0, total + 1 - length)]
    gone = np.cumsum(change, dtype=np.int32)[:total] > 0
    for i in np.flatnonzero(whole & (sizes >= length)):
        gone[first[i] : first[i + 1]] = True
    begins = gone & ~np.concatenate([[False], gone[:-1]])[:total]
    filled = first[:-1][sizes > 0]
    begins[filled] = gone[filled]  # a run does not go on into the next text
    stay = np.concatenate([[0], np.cumsum(~gone)])
    runs = np.concatenate([[0], np.cumsum(begins)])
    kept = data[~gone]
    out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(stay[first].astype(np.int32)), pa.py_buffer(kept)])
    return out, np.diff(runs[first])


def _halves(rows: DataFrame) -> DataFrame:
    """Every row of a hot class as one of two classes with half the window, one for either end of its strings."""
    half = F.expr("window div 2")
    left, right = F.octet_length("left"), F.octet_length("right")

    def part(column: str, at: Column, n: Column) -> Column:
        return F.substring(F.col(column), at.cast("int"), F.greatest(n, F.lit(0)).cast("int"))

    before = rows.where(left >= half).select(
        "key", F.xxhash64("sub", F.lit(0), part("left", left - half + 1, half)).alias("sub"), "block",
        part("left", F.lit(1), left - half).alias("left"), part("right", F.lit(1), F.col("window") - 1 - half).alias("right"),
        (F.col("window") - half).cast("int").alias("window"), (F.col("shift") + half).cast("int").alias("shift"),
    )
    rest = F.col("window") - half
    behind = rows.where(right >= rest).select(
        "key", F.xxhash64("sub", F.lit(1), part("right", F.lit(1), rest)).alias("sub"), "block",
        part("left", F.greatest(left - half + 1, F.lit(0)) + 1, half - 1).alias("left"), part("right", rest + 1, half - 1).alias("right"),
        half.cast("int").alias("window"), F.col("shift"),
    )
    return before.unionByName(behind)


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """All columns of ``docs``, with ``n_bytes, n_removed, n_spans, kept`` (binary).

    A byte is removed if a string of ``length`` bytes that covers it starts at
    another place too, in this or any document, as the input has them. Null texts are
    empty and lose nothing, as do texts shorter than ``length``. Rows that
    repeat are documents of their own, so they repeat each other. Columns named
    like the results are replaced; other columns, clashing or not, are kept.
    """
    if window > 64:
        raise ValueError("a window's starts are told by the bits of a 64-bit number")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "_u", "_tag", "_found", "_whole")
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    spark = docs.sparkSession
    # A place is its document's first hash, and a number: the second hash (31 bits) above the place in the text.
    tag = F.xxhash64(F.lit(SECOND_SEED), text).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
    known = docs.withColumn("_u", F.xxhash64(text)).withColumn("_tag", F.shiftleft(tag, 32))
    long_enough = F.octet_length("text") >= length
    middle, gram = length + 1 - window, min(GRAM, length // 2)

    # 1. Coarse anchors, and those whose gram has two different places.
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in _slices(whole_batch):
                keys, us, qs = [], [], []
                for data, u, own in zip(_texts(batch), batch.column("_u").to_pylist(), batch.column("_tag").to_pylist(), strict=True):
                    at = _changes(coarse_anchors(data, length, gram))
                    keys.append(_hashes(data[q : q + gram] for q in at.tolist()))
                    us.append(np.full(len(at), u, np.int64))
                    qs.append(at | own)
                yield _table([keys, us, qs], "key long, u long, q long")

    place = F.xxhash64("u", "q")
    found = known.where(long_enough).select("text", "_u", "_tag").mapInArrow(find, "key long, u long, q long")
    repeated = found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b")
    # As an expression the key is dealt out anew, so that a hot one's rows can be split in the join.
    repeated = repeated.select(F.col("key").bitwiseXOR(1).bitwiseXOR(1).alias("key"))
    asked = durable(found.join(repeated, "key", "left_semi").groupBy("u").agg(F.collect_set("q").alias("qs")))
    release(spark)

    # 2. The blocks of the strings around them, equal ones aggregated.
    def blocks_of(data: bytes, own: int, qs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = anchors(data, length, window, gram, {q ^ own for q in qs if q >> 32 == own >> 32})
        places = at.tolist()
        keys = _hashes(data[q : q + middle] for q in places)
        sides = _hashes(min(q, window - 1).to_bytes(4, "little") + data[max(0, q - window + 1) : q] + data[q + middle : q + length] for q in places)
        return keys, sides, at | own

    def rows_of(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
        return zip(_texts(batch), *(batch.column(c).to_pylist() for c in columns), strict=True)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in _slices(whole_batch):
                found = [blocks_of(*row) for row in rows_of(batch, "_tag", "qs")]
                us = [np.full(len(x[2]), u, np.int64) for x, u in zip(found, batch.column("_u").to_pylist(), strict=True)]
                yield _table([[x[0] for x in found], [x[1] for x in found], us, [x[2] for x in found]], "key long, block long, u long, q long")

    def with_text(lists: DataFrame) -> DataFrame:
        # The lists are hashed, so texts need no sorting.
        return known.join(lists.hint("shuffle_hash"), F.col("_u") == F.col("u")).select("text", "_u", "_tag", *[c for c in lists.columns if c != "u"])

    places = durable(with_text(asked).mapInArrow(blocks, "key long, block long, u long, q long"))
    release(spark)
    distinct = places.groupBy("key", "block").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min("u").alias("u"))
    kinds = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.col("a") != F.col("b")).alias("copies")).where("kinds > 1 OR copies")
    distinct = durable(distinct.join(kinds.select("key", "kinds"), "key"))
    release(spark)

    # 3. Blocks of classes with several kinds, one document of each, with their edges.
    def chosen(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
        for data, own, qs, asked_ in rows_of(batch, "_tag", "qs", "asked"):
            mine = {(x["key"], x["block"]) for x in asked_}
            for key, block, q in zip(*(x.tolist() for x in blocks_of(data, own, qs)), strict=True):
                if (key, block) in mine:
                    yield data, key, block, q ^ own

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in _slices(whole_batch):
                rows = [(key, block, *_edges(data, q, length, window)) for data, key, block, q in chosen(batch)]
                keys, ids, left, right = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
                yield _table([[np.array(keys, np.int64)], [np.array(ids, np.int64)], left, right], "key long, block long, left binary, right binary")

    lists = distinct.where("kinds > 1").groupBy("u").agg(F.collect_list(F.struct("key", "block")).alias("asked"))
    rows = with_text(lists.join(asked, "u")).mapInArrow(edges, "key long, block long, left binary, right binary").distinct()
    rows = rows.select("key", F.lit(0).cast("long").alias("sub"), "block", "left", "right", F.lit(window).alias("window"), F.lit(0).alias("shift"))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def ordered() -> pd.DataFrame:
            out = []
            offsets = repeated_offsets([(row[:2], row[3], row[4]) for row in held], held[0][5])
            for (key, _, block, _, _, _, shift), own in zip(held, offsets, strict=True):
                if own:
                    out.append((key, block, _mask(o + shift for o in own)))
            return pd.DataFrame(out, columns=["key", "block", "mask"])

        symbols = 0
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in ("key", "sub", "block", "left", "right", "window", "shift")), strict=True))
        for (_, _, span), of_class in groupby(rows, key=lambda row: (row[0], row[1], row[5])):
            if held and (span != held[-1][5] or symbols > TEXT_SYMBOLS):
                yield ordered()
                held, symbols = [], 0
            whole = list(of_class)
            for i, left, right in trimmed([row[3:5] for row in whole], span):
                held.append((*whole[i][:3], left, right, *whole[i][5:]))
                symbols += len(left) + len(right) + 2
        if held:
            yield ordered()

    # 4. Hot classes are split until none is left, at the latest when all strings of a class are one.
    # The sizes of classes come with their rows, so none is joined; a hot one's rows are sorted, which may spill.
    # Few bytes are much work here, so the number of tasks must not be left to their size.
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    verdicts = distinct.where("a <> b").select("key", "block", F.lit(_mask(range(window))).cast("long").alias("mask"))
    one = F.expr("shiftleft(1L, shift)")
    of_class = Window.partitionBy("key", "sub")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(of_class))
    while True:
        rows = durable(rows.where("n > 1"))
        release(spark)  # the texts dealt out for these edges
        calm = rows.where(F.col("n") <= most_blocks).drop("n").repartition(tasks, "key", "sub").sortWithinPartitions("window", "key", "sub")
        verdicts = verdicts.unionByName(calm.mapInPandas(order, "key long, block long, mask long"))
        hot = rows.where(F.col("n") > most_blocks).drop("n")
        if hot.isEmpty():
            break
        verdicts = verdicts.unionByName(hot.where("window = 1").select("key", "block", one.alias("mask")))
        rows = _halves(hot.where("window > 1")).withColumn("n", F.count(F.lit(1)).over(of_class))

    # 5. Verdicts return to their places, and the places to their documents.
    verdicts = verdicts.groupBy("key", "block").agg(F.bit_or("mask").alias("mask"))  # one for each block, however often it was split
    spans = places.join(verdicts, ["key", "block"]).groupBy("u").agg(F.collect_set(F.struct("q", "mask")).alias("_found"))
    copied = known.where(long_enough).groupBy("_u", "_tag").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    copied = copied.groupBy(F.col("_u").alias("u")).agg(F.collect_set("_tag").alias("_whole"))
    removal = spans.join(copied, "u", "full")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in _slices(whole_batch):
                kept = pc.coalesce(batch.column("text").cast(pa.binary()), pa.scalar(b"", pa.binary()))
                sizes = pc.binary_length(kept).cast(pa.int64())
                found, copies = batch.column("_found"), batch.column("_whole")
                hit = pc.or_(pc.is_valid(found), copies).to_numpy(zero_copy_only=False)
                runs = np.zeros(len(batch), np.int64)
                if hit.any():  # other texts pass as they are
                    at = pa.array(np.flatnonzero(hit))
                    changed, runs[hit] = _cut_texts(kept.take(at), batch.column("_tag").take(at).to_numpy(), found.take(at), copies.take(at).to_numpy(zero_copy_only=False), length, window)
                    kept = pc.replace_with_mask(kept, pa.array(hit), changed)
                removed = pc.subtract(sizes, pc.binary_length(kept).cast(pa.int64()))
                names = [*columns, "n_bytes", "n_removed", "n_spans", "kept"]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], sizes, removed, pa.array(runs), kept], names=names)

    fields = [T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()))]
    placed = known.join(removal.hint("shuffle_hash"), F.col("_u") == F.col("u"), "left").select(*columns, "_tag", "_found", F.coalesce(F.array_contains("_whole", F.col("_tag")), F.lit(False)).alias("_whole"))
    return placed.mapInArrow(cut, T.StructType([*docs.schema.fields, *fields]))


def kept_text(kept: Column) -> Column:
    """Remaining bytes as text; what is left of a character cut in two is dropped."""
    text = kept.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
