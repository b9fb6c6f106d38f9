"""Hierarchical multi-length packing of documents into training sequences.

Every document is tokenised where it lies and cut into full windows of the
longest tier; what remains is routed to the smallest context-size tier that
holds it. Tiers are packed from the longest down: a window is opened by a
document of its tier, and the gap behind it is filled from shorter tiers,
the largest that fits first, the last one cut to fit. So windows are full,
and full windows of a power of two need no padding. What is left at the end
of a partition (less than one long window) is dealt to short full windows,
and only a rest below the shortest tier is padded.

Windows are grouped into steps whose lengths add up to the step size exactly,
so steps cost the same: a window goes to the open step with the least room that
holds it. As lengths are powers of two, a few steps at most are open at a time,
and only those open at a partition's end stay short.

There is no shuffle: each partition packs alone and leaves less than one
window of the shortest tier unfilled. Memory holds one batch of ids. A window
is identified by its partition and its number there, so a task that runs again
on another executor names it alike.

Null texts are empty texts: one piece with the end id alone. Repeated rows are
packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

TIERS = (64, 128, 256, 512, 1024)
STEP_TOKENS = 8 * 1024
BATCH_DOCS = 512

#: The byte-level split pattern (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Outside these characters, or with white space before a space, words are not encoded one by one.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|\s |<\|")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def load_words(path: str) -> tiktoken.Encoding:
    """The tokenizer's own vocabulary as ranks, which encodes single words much faster."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {x["content"] for x in stated["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in stated["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding(name="words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class WordEncoder(dict):
    """Ids of texts as little-endian 32-bit bytes, words encoded once and kept.

    The split pattern always breaks before a space that follows a character
    other than white space, so such words can be encoded apart, by the ranks
    of the tokenizer's own file. Texts with unusual characters or a special
    token are encoded whole by the tokenizer itself.
    """

    def __init__(self, path: str, keep: int = 200_000) -> None:
        super().__init__()
        self.path, self.words, self.keep = path, load_words(path), keep

    def plain(self, text: str) -> bytes:
        return np.array(self.words.encode_ordinary(text), dtype="<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(load_tokenizer(self.path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.plain(" " + word)
        return found

    def encode(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self.whole(text)
        if len(self) > self.keep:
            self.clear()
        words = text.split(" ")
        return self.plain(words[0]) + b"".join(map(self.__getitem__, words[1:]))


class Packer:
    """Packs fragments (document, start, id bytes, document's ids) into windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = sorted(tiers)
        self.pools: list[list[tuple]] = [[] for _ in self.tiers]

    def tier_of(self, length: int) -> int:
        return next(i for i, t in enumerate(self.tiers) if length <= t)

    def add(self, fragment: tuple) -> None:
        self.pools[self.tier_of(len(fragment[2]) // 4)].append(fragment)

    def route(self, doc_id: int, ids: bytes, start: int = 0) -> Iterator[tuple[int, list[tuple]]]:
        """Full windows of the longest tier; the rest of the document waits in its pool."""
        total, top = len(ids) // 4, self.tiers[-1]
        full = total - total % top
        for at in range(0, full, top):
            yield top, [(doc_id, at, ids[4 * at : 4 * (at + top)], total)]
        if total > full:
            self.add((doc_id, full, ids[4 * full :], total))

    def _fill(self, gap: int, below: int) -> tuple | None:
        """A fragment of ``gap`` ids at most: from shorter tiers if they have any."""
        for i in range(below - 1, -1, -1):
            if self.pools[i] and self.tiers[i] <= gap:
                return self.pools[i].pop()
        source = next((p for p in self.pools if p), None)
        if source is None:
            return None
        doc, start, ids, total = source.pop()
        if len(ids) // 4 > gap:
            self.add((doc, start + gap, ids[4 * gap :], total))
            ids = ids[: 4 * gap]
        return doc, start, ids, total

    def windows(self) -> Iterator[tuple[int, list[tuple]]]:
        """All full windows; an unfilled one goes back to the pools."""
        for i in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[i]
            while self.pools[i]:
                window = [self.pools[i].pop()]
                gap = size - len(window[0][2]) // 4
                while gap and (x := self._fill(gap, i)):
                    window.append(x)
                    gap -= len(x[2]) // 4
                if gap:
                    for x in window:
                        self.add(x)
                    return
                yield size, window

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        """What cannot fill a window: short full windows, then one that is padded."""
        left = [x for pool in reversed(self.pools) for x in pool]
        self.pools = [[] for _ in self.tiers]
        total = sum(len(x[2]) // 4 for x in left)
        while total:
            size = next((t for t in reversed(self.tiers) if t <= total), total)
            window, gap = [], size
            while gap:
                doc, start, ids, n = left.pop(0)
                if len(ids) // 4 > gap:
                    left.insert(0, (doc, start + gap, ids[4 * gap :], n))
                    ids = ids[: 4 * gap]
                window.append((doc, start, ids, n))
                gap -= len(ids) // 4
            total -= size
            yield (size if size in self.tiers else self.tiers[-1]), window


class Steps:
    """Groups windows into steps of exactly ``size`` ids."""

    def __init__(self, size: int) -> None:
        self.size, self.open, self.n = size, [], 0  # open: (room, step)

    def place(self, tier: int) -> int:
        room = min((x for x in self.open if x[0] >= tier), default=None)
        if room is None:
            room = (max(self.size, tier), self.n)
            self.n += 1
        else:
            self.open.remove(room)
        if room[0] > tier:
            self.open.append((room[0] - tier, room[1]))
        return room[1]


def _rows(windows: list[tuple[int, list[tuple]]], partition: int, first: int, steps: Steps) -> pd.DataFrame:
    """Rows of the windows, longest first."""
    out = []
    for k, (tier, pieces) in enumerate(sorted(windows, key=lambda w: -w[0])):
        at, step = 0, (partition << 40) + steps.place(tier)
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, (partition << 40) + first + k, at, tier, step))
            at += len(ids) // 4
    return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences (``SCHEMA``).

    Padding is ``tier`` less the lengths of a sequence's pieces, and not zero
    only in a partition's last window. Columns other than ``doc_id`` and
    ``text`` are ignored; ids may be null or repeat. A very long text is cut
    into full windows of the longest tier, one after the other.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = WordEncoder(tokenizer_path), Packer(tiers)
        partition, first, steps = TaskContext.get().partitionId(), 0, Steps(step_tokens)
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), batch["text"].to_numpy()
            for at in range(0, len(batch), BATCH_DOCS):
                full = []
                for doc, text in zip(ids[at : at + BATCH_DOCS], texts[at : at + BATCH_DOCS], strict=True):
                    full += packer.route(None if pd.isna(doc) else int(doc), encoder.encode(text or "") + end)
                full += packer.windows()
                if full:
                    yield _rows(full, partition, first, steps)
                    first += len(full)
        last = list(packer.rest())
        if last:
            yield _rows(last, partition, first, steps)

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
