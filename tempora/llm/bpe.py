"""Byte-level BPE: encoding and decoding as a tree reduction over a monoid.

An element is the encoding of a stretch of text. ``join`` is associative: the
encoding of a joined text is that of its halves but for a window around the
seam. The window grows outward, doubling, until either side shows a place
where every tokenisation by the split pattern must break whatever stands around
it: a space after a character that is no white space, or sentence punctuation or
a line end after a letter. No alternative of the pattern runs across such a place
or looks past it, so tokens outside the window are final. For a pattern whose
sure places are not known (``SURE_BREAKS``) the window grows to the whole stretch,
which is right for any pattern. Decoding concatenates the bytes of halves up the tree.

Texts stay where they are (no shuffle); null texts are empty texts and get no
ids. Each row is independent, so equal rows, clashing column names and lost
executors need no care.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

LEAF_CHARS = 512
FIRST_WINDOW = 64

#: Split patterns, and places where any tokenisation by them breaks.
SURE_BREAKS = {public_tokenizers.PATTERN: re.compile(r"(?<=\S) |(?<=[A-Za-z])[.,\n]")}
_NOWHERE = re.compile(r"(?!)")


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str) -> tiktoken.Encoding:
    """The rank file as an encoding, once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name="ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _last_break(sure: re.Pattern, text: str, lo: int, hi: int, first: int = FIRST_WINDOW) -> int:
    """The last sure break after ``lo`` and before ``hi``; ``lo`` if there is none."""
    reach = first
    while True:
        start = max(lo, hi - reach)
        found = -1
        for m in sure.finditer(text, max(lo + 1, start), hi):
            found = m.start()
        if found > lo:
            return found
        if start == lo:
            return lo
        reach *= 2


def _first_break(sure: re.Pattern, text: str, lo: int, hi: int, first: int = FIRST_WINDOW) -> int:
    """The first sure break after ``lo`` and before ``hi``; ``hi`` if there is none."""
    reach = first
    while True:
        end = min(hi, lo + reach)
        m = sure.search(text, lo + 1, end)
        if m:
            return m.start()
        if end == hi:
            return hi
        reach *= 2


def join(encoding: tiktoken.Encoding, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
    """Encoding of ``text[lo:hi]`` from those of its halves."""
    sure = SURE_BREAKS.get(encoding._pat_str, _NOWHERE)
    a, b = _last_break(sure, text, lo, mid), _first_break(sure, text, mid, hi)
    encode = encoding.encode_ordinary
    drop = len(encode(text[a:mid]))
    skip = len(encode(text[mid:b]))
    return left[: len(left) - drop] + encode(text[a:b]) + right[skip:]


def encode_tree(encoding: tiktoken.Encoding, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of the whole text by recursive halving."""

    def reduce(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return join(encoding, text, lo, mid, hi, reduce(lo, mid), reduce(mid, hi))

    return reduce(0, len(text))


def decode_tree(encoding: tiktoken.Encoding, ids: list[int], leaf: int = LEAF_CHARS) -> bytes:
    """Bytes of the ids, halves concatenated."""

    def reduce(lo: int, hi: int) -> bytes:
        if hi - lo <= leaf:
            return encoding.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return reduce(lo, mid) + reduce(mid, hi)

    return reduce(0, len(ids))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` for every text of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_ranks(ranks_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                ids = [encode_tree(encoding, t or "", leaf) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": ids, "decoded": [decode_tree(encoding, x, leaf) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the same, digested in the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_ranks(ranks_path, pattern)
        for batch in batches:
            counts, id_hashes, byte_hashes = [], [], []
            for text in batch["text"]:
                ids = encode_tree(encoding, text or "", leaf)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                byte_hashes.append(hashlib.sha256(decode_tree(encoding, ids, leaf)).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_tokens": counts, "ids_sha256": id_hashes, "decoded_sha256": byte_hashes})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
