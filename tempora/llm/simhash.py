"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: the product of two perfect binary
Golay codes on 23 bits each (2^24 anchors on 46 of the 64 bits). Every point
of a block has exactly one anchor within the covering radius of 3, its home.
Two fingerprints that differ in at most ``t`` bits differ by ``d1`` and ``d2``
in the blocks with ``d1 + d2 <= t``, so the second lies within ``3 + d1`` and
``3 + d2`` of the first one's home. Each distinct fingerprint is replicated to
every anchor within covering radius plus threshold in that sense, and compared,
at each anchor, with the fingerprints that are at home there.

``keep_first`` decides by similarity. Near copies are found by the word
shingles they hold: a wide fingerprint of the shingles (its bits estimate the
angle between shingle sets, and so their Jaccard similarity) decides. Texts
whose least shingle hashes nobody shares meet nobody. Those that share one with a bounded
number of others are compared there; those that share one with more go on, and
several fingerprints of their shingle sets are each dealt to their anchors.
A text's rows thus depend on the texts it shares shingles with, not on the table.

Equal fingerprints are one node from the start, so copies cost nothing. Many
different fingerprints at one anchor are looked up by bit changes instead of
compared in pairs, so a task's work grows in proportion to its rows. What leaves an
anchor is a spanning forest of its links, which loses no link between texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.llm.common import durable, release
from tempora.llm.components import components, local_forest

SEED = 42
BLOCK = 23
#: Generator polynomial of the binary Golay code (fixed value): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
COVERING_RADIUS = 3
PAIRS_AT_ONCE = 2048


# -- fingerprints --------------------------------------------------------------


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the lower-cased text's word shingles, repeats included; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: -words + 1 or None].tolist(), ends[words - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fp long")


# -- the covering code ---------------------------------------------------------


def _syndrome(x: np.ndarray) -> np.ndarray:
    out = x.astype(np.int64).copy()
    for bit in range(BLOCK - 1, 10, -1):
        out = np.where((out >> bit) & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


@lru_cache(maxsize=1)
def _near_words(most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each excess e: changes of weight 3 + e or less (exactly, for e > 0), ordered by syndrome, and where each syndrome begins."""
    changes, begins = [], []
    for excess in range(most + 1):
        weights = range(COVERING_RADIUS + 1) if excess == 0 else [COVERING_RADIUS + excess]
        masks = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(BLOCK), w)], np.int64)
        syndromes = _syndrome(masks)
        order = np.argsort(syndromes, kind="stable")
        changes.append(masks[order])
        begins.append(np.searchsorted(syndromes[order], np.arange(2049)))
    return changes, begins


def _expand(rows: np.ndarray, syndromes: np.ndarray, excess: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row once for every change that leads to an anchor at this excess."""
    changes, begins = _near_words(most)
    first, n = begins[excess][syndromes], begins[excess][syndromes + 1] - begins[excess][syndromes]
    at = np.repeat(np.arange(len(rows)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, changes[excess][first[at] + within]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index into ``fps``, anchor, and whether the anchor is the fingerprint's home."""
    x = fps.view(np.uint64)
    blocks = [(x & np.uint64((1 << BLOCK) - 1)).astype(np.int64), ((x >> np.uint64(BLOCK)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)]
    syndromes = [_syndrome(b) for b in blocks]
    out = []
    for e1 in range(threshold + 1):
        for e2 in range(threshold + 1 - e1):
            at1, change1 = _expand(blocks[0], syndromes[0], e1, threshold)
            at2, change2 = _expand(blocks[1][at1], syndromes[1][at1], e2, threshold)
            word1 = (blocks[0][at1] ^ change1)[at2] >> 11
            word2 = (blocks[1][at1][at2] ^ change2) >> 11
            out.append((at1[at2], word1 << 12 | word2, np.full(len(at2), e1 + e2 == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# -- links at an anchor --------------------------------------------------------


@lru_cache(maxsize=4)
def _bit_changes(threshold: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for w in range(1, threshold + 1) for bits in combinations(range(64), w)], np.uint64)


def near_pairs(home: np.ndarray, there: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different fingerprints, one at home, that differ in at most ``threshold`` bits."""
    home, there = home.view(np.uint64), np.unique(there.view(np.uint64))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if min(len(home), len(there)) <= PAIRS_AT_ONCE:
        step = max(1, (1 << 22) // max(1, len(there)))
        for at in range(0, len(home), step):
            part = home[at : at + step]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ there[None, :]) <= threshold)
            found.append((part[i], there[j]))
    else:
        for change in _bit_changes(threshold):
            want = home ^ change
            at = np.minimum(np.searchsorted(there, want), len(there) - 1)
            hit = there[at] == want
            found.append((home[hit], want[hit]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (home[:0], home[:0])
    apart = a != b
    return a[apart].view(np.int64), b[apart].view(np.int64)


def links(fps: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: a spanning forest, anchor by anchor, of the links of distinct ``fp``."""

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            for start in range(0, len(values), 20_000):
                part = values[start : start + 20_000]
                at, anchor, home = anchors(part, threshold)
                yield pd.DataFrame({"anchor": anchor.astype(np.int32), "fp": part[at], "home": home})

    # A fingerprint is small and its replicas are many, so tasks must not be left to their size.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.repartition(tasks, "fp").mapInPandas(replicate, "anchor int, fp long, home boolean").repartition("anchor").sortWithinPartitions("anchor")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def cells(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[pd.DataFrame]:
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(anchor)]])
            homes = np.add.reduceat(home, starts) if len(anchor) else starts
            left, right = [], []
            for lo, hi in zip(starts[(homes > 0) & (ends - starts > 1)], ends[(homes > 0) & (ends - starts > 1)], strict=True):
                a, b = near_pairs(np.ascontiguousarray(fp[lo:hi][home[lo:hi]]), fp[lo:hi], threshold)
                if len(a):
                    a, b = local_forest(a, b)
                    left.append(a)
                    right.append(b)
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

        for batch in batches:
            held = [np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("anchor", "fp", "home"), strict=True)]
            whole = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last anchor may go on
            if whole:
                yield from cells(*(h[:whole] for h in held))
                held = [h[whole:] for h in held]
        if len(held[0]):
            yield from cells(*held)

    return dealt.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``: the class of every row, named by its smallest ``doc_id``.

    Null, empty and wordless texts have fingerprint zero and link like any
    other. Rows that repeat belong to one class. A null ``doc_id`` is returned
    with its class, but names it only if the class has no other. Columns other than
    ``doc_id`` and ``text`` are ignored.
    """
    marked = durable(fingerprints(docs, words))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), threshold)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# -- near copies by similarity ---------------------------------------------------

TABLES = 18  # fingerprints dealt to anchors, of the 46 bits an anchor looks at
PARTS = 13  # 64-bit parts of the wide fingerprint, which the tables divide among them
SLACK = 2.5  # deviations by which a fingerprint may miss the similarity asked for
BUCKET_ROWS = 2048  # texts of one least hash that are compared there; more go on to anchors
CELL_ROWS = 4096  # rows of a cell that are compared in one task; larger cells are cut
SMALL = 24  # cells up to this size are compared many at once
HEADS = [f"head{i}" for i in range(8)]  # least hashes of a shingle set; sets of similarity 0.8 share none of 8 once in 390,000 times
PAIRS_OUT = 1 << 20  # pairs judged at once
_LANE = np.uint64(0x0101010101010101)


def _mixed(hashes: np.ndarray, parts: int) -> np.ndarray:
    """``parts`` independent 64-bit hashes of each hash, one row for each part."""
    x = hashes[None, :] + (np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray, parts: int) -> bytes:
    """SimHash of a set of hashes, ``parts`` times 64 bits; zero for an empty set."""
    n = len(hashes)
    if not n:
        return bytes(8 * parts)
    ones = np.zeros((parts, 8, 8), np.int64)
    for at in range(0, n, 255 * 256):
        x = _mixed(hashes[at : at + 255 * 256], parts)
        rows = -(-x.shape[1] // 255)
        x = np.pad(x, ((0, 0), (0, rows * 255 - x.shape[1]))).reshape(parts, rows, 255)
        for bit in range(8):  # eight counters at a time, one in each byte
            lanes = ((x >> np.uint64(bit)) & _LANE).sum(axis=2, dtype=np.uint64)
            ones[:, :, bit] += lanes.view(np.uint8).reshape(parts, rows, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(ones.reshape(parts, 64) * 2 > n, axis=1, bitorder="little").tobytes()


def shingle_hashes(tokens: list[bytes], words: int) -> set[int]:
    """Hashes of the distinct word shingles (fewer words: of the whole sequence)."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return {digest(joined, SEED)} if tokens else set()
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return {digest(joined[a:b], SEED) for a, b in zip(starts[: -words + 1 or None].tolist(), ends[words - 1 :].tolist(), strict=True)}


def text_shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's set of word shingles."""
    shingles = shingle_hashes((text or "").encode().lower().split(), words)
    return np.fromiter(shingles, np.uint64, len(shingles))


def shingle_mark(text: str | None, words: int) -> bytes:
    """Fingerprint of a text's set of word shingles."""
    return wide_fingerprint(text_shingles(text, words), PARTS)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of a set of hashes under each of several mixings, as signed longs; the largest number for an empty set."""
    least = np.full(len(HEADS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 255 * 256):
        least = np.minimum(least, _mixed(hashes[at : at + 255 * 256], len(HEADS)).min(axis=1))
    return least.view(np.int64)


def table_marks(marks: pd.Series) -> np.ndarray:
    """The fingerprints for each table, one row for each mark."""
    bits = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), 8 * PARTS), axis=1, bitorder="little")
    bits = bits[:, : TABLES * 2 * BLOCK].reshape(len(marks), TABLES, 2 * BLOCK)
    return np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, 64 - 2 * BLOCK))), axis=2, bitorder="little").view("<i8")[:, :, 0]


def bits_for(similarity: float, slack: float = SLACK) -> int:
    """Differing bits at which sets of this Jaccard similarity count as near copies: their mean, and ``slack`` deviations."""
    share = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity)))) / np.pi
    return int(64 * PARTS * share + slack * np.sqrt(64 * PARTS * share * (1 - share)))


def _words_of(marks: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(marks), "<u8").reshape(-1, PARTS)


def _near(sig: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the rows ``a`` and ``b`` differ in at most ``most`` bits."""
    out = np.empty(len(a), bool)
    for s in range(0, len(a), 1 << 17):
        out[s : s + (1 << 17)] = np.bitwise_count(sig[a[s : s + (1 << 17)]] ^ sig[b[s : s + (1 << 17)]]).sum(axis=1, dtype=np.int32) <= most
    return out


def _cell_pairs(sig: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one large cell that differ in at most ``most`` bits, but for those that change nothing.

    Rows near a leader form its tree and are paired with it only; any two rows
    of different trees are compared. So nothing that could join two trees is
    lost, and many copies of one text cost rows, not pairs.
    """
    tree, rest = np.full(len(sig), -1), np.arange(len(sig))
    while len(rest):
        near = np.bitwise_count(sig[rest] ^ sig[rest[0]]).sum(axis=1) <= most
        tree[rest[near]] = rest[0]
        yield np.full(int(near.sum()) - 1, rest[0]), rest[near][1:]
        rest = rest[~near]
    order = np.argsort(tree, kind="stable")
    own = sig[order]
    ends = np.append(np.flatnonzero(np.diff(tree[order])) + 1, len(sig))
    for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
        for x in range(lo, hi, 64):
            for y in range(hi, len(sig), 4096):
                a, b = np.nonzero(np.bitwise_count(own[x : min(x + 64, hi), None] ^ own[None, y : y + 4096]).sum(axis=2, dtype=np.int32) <= most)
                if len(a):
                    yield order[a + x], order[b + y]


class _Forest:
    """Links gathered by a task, kept as a forest, so that no task puts out more links than it has nodes."""

    def __init__(self) -> None:
        self.a, self.b, self.new, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.new.append((a, b))
        self.held += len(a)
        if self.held > PAIRS_OUT:
            self.shrink()

    def shrink(self) -> None:
        a, b = (np.concatenate([old, *new]) for old, new in zip((self.a, self.b), ([x for x, _ in self.new], [y for _, y in self.new]), strict=True))
        self.a, self.b = local_forest(a, b) if len(a) else (a, b)
        self.new, self.held = [], 0

    def rows(self) -> Iterator[pd.DataFrame]:
        self.shrink()
        for s in range(0, len(self.a), 10_000):
            yield pd.DataFrame({"a": self.a[s : s + 10_000], "b": self.b[s : s + 10_000]})


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins and ends."""
    n = len(keys[0])
    cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if n else np.zeros(0, np.int64)
    return np.concatenate([[0], cuts]).astype(np.int64), np.concatenate([cuts, [n]]).astype(np.int64)


def home_cells(nodes: DataFrame) -> DataFrame:
    """``cell`` of every table of every node: the table and the anchor it is at home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = table_marks(batch["mark"])
            for t in range(TABLES):
                yield pd.DataFrame({"cell": anchors(np.ascontiguousarray(marks[:, t]), 0)[1].astype(np.int64) | t << 24})

    return nodes.select("mark").mapInPandas(run, "cell long")


def bitmap(cells: DataFrame) -> Broadcast:
    """The cells as bits, told to all tasks: compressed pieces of 4 kB; unpacked they have a fixed size (``TABLES`` times 2^24 bits)."""
    at = F.col("cell") + 1  # a bitmap's first bucket begins at 1
    parts = cells.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    return cells.sparkSession.sparkContext.broadcast([(int(row.bucket) - 1, zlib.compress(row.bits, 1)) for row in parts.toLocalIterator()])


def unpacked(shipped: Broadcast) -> np.ndarray:
    """The bits of a bitmap, eight to a byte."""
    out = np.zeros((TABLES << 24) // 8, np.uint8)
    for bucket, bits in shipped.value:
        out[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out


def _told(taken: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (taken[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _compare(keys: tuple[str, ...], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links (``a, b``) among the rows (``node, mark``) of equal keys, which follow each other, as a forest of the task."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, forest = None, _Forest()

        def links_of(part: pd.DataFrame) -> None:
            node, sig = part["node"].to_numpy(), _words_of(part["mark"])
            starts, ends = _groups(*(part[c].to_numpy() for c in keys))
            sizes = ends - starts
            for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
                x, y = np.triu_indices(size, 1)
                first = starts[sizes == size]
                a, b = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
                near = _near(sig, a, b, most)
                forest.add(node[a[near]], node[b[near]])
            for lo, hi in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
                for a, b in _cell_pairs(sig[lo:hi], most):
                    forest.add(node[lo + a], node[lo + b])

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            starts, _ = _groups(*(held[c].to_numpy() for c in keys))
            if starts[-1]:  # the last group may go on
                links_of(held.iloc[: starts[-1]])
                held = held.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            links_of(held)
        yield from forest.rows()

    return compare


def home_links(nodes: DataFrame, shared: DataFrame, shipped: Broadcast, most: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a, b``: a forest of the links of nodes (``node, mark``) that are at home in one cell.

    ``shared`` has the cells with several nodes and their number (``cell, n``),
    and ``shipped`` is their bitmap. A cell of more than ``cell_rows`` is cut into chunks, and its pairs of
    chunks are compared in different tasks.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = unpacked(shipped)
        for batch in batches:
            marks, node, mark = table_marks(batch["mark"]), batch["node"].to_numpy(), batch["mark"].to_numpy()
            for t in range(TABLES):
                cell = anchors(np.ascontiguousarray(marks[:, t]), 0)[1].astype(np.int64) | t << 24
                met = _told(taken, cell)
                if met.any():
                    yield pd.DataFrame({"cell": cell[met], "node": node[met], "mark": mark[met]})

    hot = shared.where(F.col("n") > cell_rows).select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    dealt = nodes.mapInPandas(deal, "cell long, node long, mark binary").join(hot, "cell", "left")
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("i", chunk).withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    dealt = dealt.select("cell", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "mark")

    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInPandas(_compare(("cell", "i", "j"), most), "a long, b long")


def visitor_links(nodes: DataFrame, shared: DataFrame, shipped: Broadcast, most: int, threshold: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``a, b``: a forest of the links between classes (``root, mark``) that meet at an anchor where one is at home.

    A node is sent to every anchor within covering radius plus ``threshold``,
    but for anchors where nobody is at home (``shipped`` is the bitmap of those where somebody is).
    Rows of one class are not compared again.
    """

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken = unpacked(shipped)
        for batch in batches:
            for s in range(0, len(batch), 4096):
                part = batch.iloc[s : s + 4096]
                marks, root, mark = table_marks(part["mark"]), part["root"].to_numpy(), part["mark"].to_numpy()
                for t in range(TABLES):
                    at, cell, home = anchors(np.ascontiguousarray(marks[:, t]), threshold)
                    cell = cell.astype(np.int64) | t << 24
                    met = _told(taken, cell)
                    yield pd.DataFrame({"cell": cell[met], "guest": ~home[met], "root": root[at[met]], "mark": mark[at[met]]})

    hot = shared.where(F.col("n") > cell_rows).select("cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    dealt = nodes.mapInPandas(replicate, "cell long, guest boolean, root long, mark binary").join(hot, "cell", "left")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("mark"), chunks).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.when(F.col("guest"), F.sequence(F.lit(0), chunks - 1)).otherwise(own)))
    dealt = dealt.select("cell", "chunk", "guest", "root", "mark").repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "guest")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts, forest = None, _Forest()
        for batch in batches:
            part = batch if hosts is None else pd.concat([hosts, batch], ignore_index=True)
            starts, ends = _groups(part["cell"].to_numpy(), part["chunk"].to_numpy())
            guest, root = part["guest"].to_numpy(), part["root"].to_numpy()
            homes = np.add.reduceat(~guest, starts, dtype=np.int64)  # hosts come first in their cell
            row = np.flatnonzero(guest)
            of = np.searchsorted(starts, row, side="right") - 1
            row, first, n = row[homes[of] > 0], starts[of][homes[of] > 0], homes[of][homes[of] > 0]
            if len(row):
                sig, upto = _words_of(part["mark"]), np.cumsum(n)
                for lo in range(0, int(upto[-1]), PAIRS_OUT):
                    k = np.arange(lo, min(lo + PAIRS_OUT, int(upto[-1])))
                    at = np.searchsorted(upto, k, side="right")
                    a, b = row[at], first[at] + k - (upto[at] - n[at])
                    apart = root[a] != root[b]
                    a, b = a[apart], b[apart]
                    near = _near(sig, a, b, most)
                    forest.add(root[a[near]], root[b[near]])
            hosts = part.iloc[starts[-1] : starts[-1] + homes[-1]].reset_index(drop=True)
        yield from forest.rows()

    return dealt.mapInPandas(compare, "a long, b long")


def similar_classes(nodes: DataFrame, most: int, threshold: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``node, root`` of the nodes (``node, mark``) linked to another: marks that meet at an anchor and differ in ``most`` bits or fewer.

    Nodes at home in one cell are linked first. Only links between the classes
    this gives are looked for among the anchors around, so a large group of
    near copies is put out a few times, not once for every anchor it reaches.
    """
    shared = durable(home_cells(nodes).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shipped = bitmap(shared)
    near = durable(home_links(nodes, shared, shipped, most, cell_rows))
    shipped.destroy()
    classed = nodes.join(components(near), "node", "left").select(F.coalesce("root", "node").alias("root"), "mark")
    shipped = bitmap(home_cells(nodes))
    far = durable(visitor_links(classed, shared, shipped, most, threshold, cell_rows))
    shipped.destroy()
    release(nodes.sparkSession)
    return components(near.unionByName(far))


def similar_texts(nodes: DataFrame, most: int, threshold: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``node, root`` of the nodes (``node, mark`` and ``HEADS``) linked to another: texts that share a head and whose marks differ in ``most`` bits or fewer.

    Nodes of one head are compared there. Those with a head of more than
    ``bucket_rows`` nodes are also linked at their anchors (``similar_classes``).
    """
    heads = nodes.select("node", F.explode(F.array_distinct(F.array(*HEADS))).alias("cell"))
    # As an expression the cell is dealt out anew, so that a hot one's rows can be split in the join.
    sizes = heads.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cell").bitwiseXOR(1).bitwiseXOR(1).alias("cell"), "n")
    met = durable(heads.join(sizes, "cell"))
    few = met.where(F.col("n") <= bucket_rows).select("cell", "node").join(nodes.select("node", "mark"), "node").select("cell", "node", "mark")
    near = durable(few.repartition("cell").sortWithinPartitions("cell").mapInPandas(_compare(("cell",), most), "a long, b long"))
    release(nodes.sparkSession)
    many = met.where(F.col("n") > bucket_rows).select("node").distinct()
    if not many.isEmpty():
        crowd = durable(nodes.join(many, "node", "left_semi").select("node", "mark"))
        far = similar_classes(crowd, most, threshold)
        near = near.unionByName(far.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return components(near)


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, threshold: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: each class keeps its smallest ``doc_id``.

    A class is what links connect; texts link whose fingerprints of the sets of
    ``words``-word shingles say that they are of ``similarity`` or more, give or
    take the fingerprint's error (``bits_for``). Texts without words are copies
    of each other. Of rows with one id all stay or all go; a null id stays only
    where its class has no other, and then in one row. An empty table gives no
    rows; very long texts are read whole.
    """
    @F.pandas_udf("binary")
    def both(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_mark(t, words))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = (text_shingles(t, words) for t in batch["text"])
            marks, heads = zip(*((wide_fingerprint(x, PARTS), least_hashes(x)) for x in sets), strict=True) if len(batch) else ((), np.zeros((0, len(HEADS)), np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": marks} | dict(zip(HEADS, np.array(heads).T, strict=True)))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = slim.mapInPandas(mark, ", ".join(["doc_id long, mark binary", *(f"{c} long" for c in HEADS)]))
    one = marked.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in HEADS])
    nodes = durable(one.withColumn("node", F.coalesce("doc_id", F.xxhash64("mark"))))
    nameless = docs.where("doc_id IS NULL").withColumn("_node", F.xxhash64(both("text")))
    roots = similar_texts(nodes.drop("doc_id"), bits_for(similarity), threshold)
    classes = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("_node"))
    kept = docs.join(classes.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    # Of a class without an id, one row.
    order = Window.partitionBy("_node").orderBy(F.xxhash64("text"), F.to_json(F.struct(*docs.columns)))
    alone = nameless.join(classes.where("doc_id IS NULL").select("_node"), "_node", "left_semi").withColumn("_n", F.row_number().over(order))
    return kept.unionByName(alone.where("_n = 1").select(*docs.columns))
