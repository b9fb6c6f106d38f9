"""Words of many texts at once, as indexes into their distinct forms and code points."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.llm.common import unit_uniform

WIDTH = 40  # code points of a word's form; longer words are read in pieces
BATCH_DOCS = 1024
BATCH_CHARS = 1_500_000
TRAINING_BYTES = 20_000  # longer texts are not learned from (they are scored whole)


def batches_of(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of bounded rows and characters, one text at least in each."""
    sizes = frame["text"].map(lambda t: len(t or "")).to_numpy()
    start, chars = 0, 0
    for at, n in enumerate(sizes):
        if at > start and (chars + n > BATCH_CHARS or at - start >= BATCH_DOCS):
            yield frame.iloc[start:at]
            start, chars = at, 0
        chars += n
    if start < len(frame):
        yield frame.iloc[start:]


def pieces(word: str, width: int) -> list[str]:
    """The letters of a word longer than ``width``, in pieces of that many that overlap by half.

    The last one ends as the word does. Without letters, the word's end stands for it.
    """
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[_alpha(points)]
    if not len(points):
        return [word[-width:]]
    letters = points.tobytes().decode("utf-32-le", "surrogatepass")
    step = width // 2
    out = [letters[i : i + width - 1] for i in range(0, max(1, len(letters) - (width - 1 - step)), step)]
    out[-1] += word[-1] if word[-1] in ".!?" else ""
    return out


class Words:
    """``at``: each word's index into ``forms``; ``lengths``: words in each text.

    Words longer than ``width`` stand as their pieces; ``first`` tells where a word begins.
    """

    def __init__(self, texts: list[str | None], join_letters: bool = False, width: int = WIDTH) -> None:
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__
        parts, lengths, firsts = [], [], []
        for text in texts:
            words = (text or "").lower().split()
            if join_letters:
                words = joined_letters(words)
            first = np.ones(len(words), bool)
            if any(len(w) > width for w in words):
                cut = [pieces(w, width) if len(w) > width else [w] for w in words]
                first = np.zeros(sum(map(len, cut)), bool)
                first[np.cumsum([0, *map(len, cut[:-1])])] = True
                words = [x for w in cut for x in w]
            firsts.append(first)
            parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
        self.at = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.first = np.concatenate(firsts) if firsts else np.zeros(0, bool)
        self.lengths = np.array(lengths, np.int64)
        self.forms = list(index)


def joined_letters(words: list[str]) -> list[str]:
    """The words, and behind each run of three or more single characters, the run as one word."""
    short = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if not short.any():
        return words
    edges = np.flatnonzero(np.diff(np.concatenate([[0], short.astype(np.int8), [0]])))
    runs = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 3]
    for a, b in reversed(runs):
        words = [*words[:b], "".join(words[a:b]), *words[b:]]
    return words


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def code_points(forms: list[str]) -> np.ndarray:
    """Code points of the words (``WIDTH`` at most), one row each, zero behind the end."""
    return np.array(forms, f"U{WIDTH}").view(np.uint32).reshape(len(forms), WIDTH)


def _alpha(points: np.ndarray) -> np.ndarray:
    return _letters()[points]


def letters_only(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters moved to the front of each row, and how many there are."""
    alpha = _alpha(points)
    order = np.argsort(~alpha, axis=1, kind="stable")
    n = alpha.sum(axis=1)
    front = np.take_along_axis(points, order, 1)
    return np.where(np.arange(points.shape[1]) < n[:, None], front, 0), n


def fit_to_learn() -> Column:
    """Rows whose ``text`` is neither empty nor very long."""
    return (F.octet_length("text") <= TRAINING_BYTES) & (F.length(F.trim("text")) > 0)


def training_rows(keys: DataFrame, docs: DataFrame, label: str, most: int) -> pd.DataFrame:
    """``text`` and label of at most ``most`` rows of each label, chosen by a hash of the id.

    ``keys`` has ``doc_id`` and the label. Ids are chosen without texts, and the texts of
    those few are picked out where they lie, so no text is shuffled to choose. Empty and
    very long texts are left out; where ``keys`` come with texts, ``fit_to_learn`` leaves them
    out before the choice.
    """
    keys = keys.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    # A label may have any number of rows. Those whose hash is low enough are some three times as many as wanted,
    # so only they are ordered; fewer than wanted pass with a chance below 1e-9.
    sizes = keys.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    low = unit_uniform(F.lit(3), F.col("doc_id")) * F.col("_size") < 3 * most + 100
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    # The sample of every label goes to the driver, so labels are few.
    few = keys.join(F.broadcast(sizes), label).where(low)
    chosen = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("doc_id", label).distinct().toPandas()
    picked = docs.sparkSession.createDataFrame([(int(i),) for i in chosen["doc_id"].unique()], "doc_id long")
    fit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fit_to_learn())
    texts = fit.join(F.broadcast(picked), "doc_id").toPandas()
    return texts.drop_duplicates("doc_id").merge(chosen.drop_duplicates("doc_id"), on="doc_id").sort_values("doc_id").reset_index(drop=True)
