"""Language ID of code-switched text by a linear-chain conditional random field.

Every word is labelled with a language. A word's score for a language is the
sum of learned weights of its prefixes, suffixes and character n-grams (hashed)
and of its log-odds in a lexicon of the training texts; learned transition
weights tie neighbours together. Forward-backward gives each word's
probabilities, and a document's language is the one with the largest mean.

Training maximises the conditional likelihood of windows of labelled documents
(a bounded sample); labelling handles whole texts, many documents in step.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.words import Words, batches_of, code_points, fit_to_learn, letters_only, training_rows

BUCKETS = 1 << 17
PER_LANGUAGE = 400  # documents learned from, of each language
WINDOW = 80  # words of a training document
ROUNDS = 50
LEXICON = 20_000
UNDETERMINED = "und"


def features(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word (row by row, -1 where there is none), and its number of letters."""
    letters, n = letters_only(code_points(forms))
    # A mark before the first letter and after the last one makes affixes n-grams of their own.
    body = np.zeros((len(forms), letters.shape[1] + 2), np.uint64)
    body[:, 1:-1] = letters
    body[:, 0] = 1
    body[np.arange(len(forms)), n + 1] = 2
    columns = []
    for size in (2, 3, 4):
        h = np.full((len(forms), body.shape[1] - size + 1), size, np.uint64)
        for k in range(size):
            h = (h ^ body[:, k : k + h.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        fits = np.arange(h.shape[1]) <= (n + 2 - size)[:, None]
        columns.append(np.where(fits & (n > 0)[:, None], (h % np.uint64(BUCKETS)).astype(np.int64), -1))
    return np.concatenate(columns, axis=1), n


class Field:
    """The trained model: languages, weights, lexicon and transitions."""

    def __init__(self, langs: list[str], weights: np.ndarray, lexicon: dict[str, np.ndarray], trust: np.ndarray, steps: np.ndarray, first: np.ndarray) -> None:
        self.langs, self.weights, self.lexicon, self.trust, self.steps, self.first = langs, weights, lexicon, trust, steps, first

    def emissions(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, n = np.zeros((len(forms), len(self.langs))), np.zeros(len(forms), np.int64)
        padded = np.vstack([self.weights, np.zeros((1, len(self.langs)))])
        for at in range(0, len(forms), 16384):
            cols, n[at : at + 16384] = features(forms[at : at + 16384])
            for c in np.flatnonzero((cols >= 0).any(axis=0)):
                out[at : at + 16384] += padded[cols[:, c]]
        return out + self.listed(forms) * self.trust, n

    def listed(self, forms: list[str]) -> np.ndarray:
        none = np.zeros(len(self.langs))
        return np.array([self.lexicon.get(w, none) for w in forms]).reshape(len(forms), len(self.langs))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Many chains laid end to end, in step: forward and backward terms, and the words' own factors.

    The terms are scaled at each word; empty chains have no rows.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    move, ahead = np.exp(steps - steps.max()), np.empty_like(e)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")  # chains longer than t
    a = None
    for t, k in enumerate(active):
        at = starts[:k] + t
        a = e[at] * (np.exp(first - first.max()) if a is None else a[:k] @ move)
        a = a / a.sum(axis=1, keepdims=True)
        ahead[at] = a
    behind = np.ones_like(e)
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = (e[at + 1] * behind[at + 1]) @ move.T
        behind[at] = b / b.sum(axis=1, keepdims=True)
    return ahead, behind, e


def marginals(ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Each word's probabilities."""
    joint = ahead * behind
    return joint / joint.sum(axis=1, keepdims=True)


def transitions(ahead: np.ndarray, behind: np.ndarray, e: np.ndarray, inner: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Expected number of each transition; ``inner`` are the words that have a next one."""
    joint = ahead[inner][:, :, None] * np.exp(steps)[None] * (e * behind)[inner + 1][:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def train(sample: pd.DataFrame, seed: int = 42) -> Field:
    """Fit the field to ``text, lang`` rows."""
    langs = sorted(sample["lang"].unique())
    if not langs:
        return Field([], np.zeros((BUCKETS, 0)), {}, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    rng, windows = np.random.default_rng(seed), []
    for text in sample["text"]:
        words = text.split()
        start = int(rng.integers(0, max(1, len(words) - WINDOW + 1)))
        windows.append(" ".join(words[start : start + WINDOW]))
    words, k = Words(windows), len(langs)
    truth = np.repeat(np.searchsorted(langs, sample["lang"]), words.lengths)
    counts = np.zeros((len(words.forms), k))
    np.add.at(counts, (words.at, truth), 1)
    share = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(words.forms)))
    odds = share - share.mean(axis=1, keepdims=True)
    top = Counter(dict(enumerate(counts.sum(axis=1)))).most_common(LEXICON)
    lexicon = {words.forms[i]: odds[i] for i, n in top if n >= 3}

    field = Field(langs, np.zeros((BUCKETS, k)), lexicon, np.full(k, 0.2), np.eye(k), np.zeros(k))
    cols, n = features(words.forms)
    lettered = n[words.at] > 0
    row, col = np.nonzero(cols >= 0)
    feature = cols[row, col]
    listed = field.listed(words.forms)
    squares = [np.full_like(x, 1e-8) for x in (field.weights, field.steps, field.trust)]
    onehot = np.eye(k)[truth]
    inner = np.ones(len(truth), bool)
    inner[np.cumsum(words.lengths)[words.lengths > 0] - 1] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[inner], truth[inner + 1]), 1)
    for _ in range(ROUNDS):
        scores = np.zeros((len(words.forms), k))
        for j in range(k):
            scores[:, j] = np.bincount(row, field.weights[feature, j], len(words.forms))
        scores = (scores + listed * field.trust)[words.at]
        terms = forward_backward(scores, words.lengths, field.steps, field.first)
        probs = marginals(*terms[:2])
        gap = (onehot - probs) * lettered[:, None] / len(truth)
        by_form = np.stack([np.bincount(words.at, gap[:, j], len(words.forms)) for j in range(k)], axis=1)
        slopes = [
            np.stack([np.bincount(feature, by_form[row, j], BUCKETS) for j in range(k)], axis=1) - 1e-7 * field.weights,
            (seen - transitions(*terms, inner, field.steps)) / len(truth) - 1e-4 * field.steps,
            (by_form * listed).sum(axis=0),
        ]
        for x, slope, square, rate in zip((field.weights, field.steps, field.trust), slopes, squares, (0.15, 0.1, 0.05), strict=True):
            square += slope**2
            x += rate * slope / np.sqrt(square)
    return field


def label(model: Field, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Language (index; one past the last: undetermined) and score of each text."""
    words = Words(texts)
    best, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
    if len(words.at) and model.langs:
        emitted, n = model.emissions(words.forms)
        probs = marginals(*forward_backward(emitted[words.at], words.lengths, model.steps, model.first)[:2]) * (n[words.at] > 0)[:, None]
        total = np.zeros((len(texts), len(model.langs)))
        full = words.lengths > 0
        total[full] = np.add.reduceat(probs, (np.cumsum(words.lengths) - words.lengths)[full], axis=0)
        mass = total.sum(axis=1)
        told = mass > 0
        best[told] = total[told].argmax(axis=1)
        score[told] = np.clip(total[told].max(axis=1) / mass[told], 0, 1)
    return best, score


def has_letter(text: str | None) -> bool:
    """Whether any word of the text has a letter."""
    forms = Words([text]).forms
    return bool(forms) and bool(letters_only(code_points(forms))[1].any())


def predict_languages(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; ``und`` and 0 where the text has no letter."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field, protocol=5))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Field = pickle.loads(shipped.value)
        names = np.array([*model.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            for part in batches_of(batch):
                best, score = label(model, list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": names[best], "score": score})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def filter_languages(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language; texts without a letter go (only they, if no language was learned)."""
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field, protocol=5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = pickle.loads(shipped.value)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                keep: list[bool] = []
                for part in batches_of(pd.DataFrame({"text": pd.Series(batch.column("text").to_pylist(), dtype=object)})):
                    texts = list(part["text"])
                    # Without a language learned, only texts without a letter go.
                    keep += (label(model, texts)[0] < len(model.langs)).tolist() if model.langs else [has_letter(t) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: a quarter of all, by the checksum of their id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Field:
    """The field fitted to at most ``per_language`` documents of each non-null ``lang``, held-out ones apart."""
    keys = docs.where(~held_out() & fit_to_learn()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    return train(training_rows(keys, docs, "lang", per_language))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs`` (``doc_id, text, lang``).

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if no row has a language to learn. Rows that repeat get equal results; very
    long texts are labelled whole; an empty table gives no rows; other columns,
    clashing or not, are ignored.
    """
    return predict_languages(docs, learn(docs, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
