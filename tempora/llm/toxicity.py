"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over all character subsequences of one length
they share, a decay to the power of the stretch each spans; so an insult with
gaps or inserted characters keeps most of its similarity, and letters set
apart are read as one word. Words that tell toxic documents of the training
sample from the others are the landmarks. A sentence is represented by its words'
similarities to each landmark, added up and mapped by the inverse root of the landmarks' own
kernel matrix, and a linear support vector machine with a logistic link
scores it. A document scores as its most toxic sentence.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.words import Words, batches_of, code_points, letters_only, training_rows

ORDER = 3
DECAY = 0.7
FLOOR = 0.3  # similarities below are taken as none, unless all letters are there
CLEAR = 0.75  # of a landmark's own kernel, to be found inside a word of more than LONG letters
LONG = 16
LANDMARKS = 48
PER_LABEL = 1500  # documents learned from, of each label
WIDTH = 24  # of the pieces that longer words are read in, short enough for an insult inside to show
POWER = 2  # of the normalised kernel, which is a kernel again
STEMS = (4, 5, 6, 7)
LEAST_DOCUMENTS = 3  # toxic documents a landmark is found in


def kernel(words: np.ndarray, landmark: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of code points (zero behind its end) with one word."""
    n, width, m = len(words), words.shape[1], len(landmark)
    equal = [words == c for c in landmark]  # m arrays, n by width
    before = np.ones((width + 1, m + 1, n))  # common subsequences one shorter, decayed to here
    for _ in range(order - 1):
        after = np.zeros((width + 1, m + 1, n))
        for k in range(1, width + 1):
            run = np.zeros(n)
            for j in range(1, m + 1):
                run = decay * run + np.where(equal[j - 1][:, k - 1], decay * decay * before[k - 1, j - 1], 0.0)
                after[k, j] = decay * after[k - 1, j] + run
        before = after
    total = np.zeros(n)
    for k in range(1, width + 1):
        for j in range(1, m + 1):
            total += np.where(equal[j - 1][:, k - 1], decay * decay * before[k - 1, j - 1], 0.0)
    return total


def self_kernel(words: np.ndarray) -> np.ndarray:
    """Each word with itself."""
    out = np.zeros(len(words))
    lengths = (words > 0).sum(axis=1)
    width = int(lengths.max(initial=0))
    n = len(words)
    before = np.ones((width + 1, width + 1, n))
    for level in range(ORDER):
        after = np.zeros((width + 1, width + 1, n))
        for k in range(1, width + 1):
            run = np.zeros(n)
            for j in range(1, width + 1):
                same = np.where((words[:, k - 1] == words[:, j - 1]) & (words[:, k - 1] > 0), DECAY * DECAY * before[k - 1, j - 1], 0.0)
                if level == ORDER - 1:
                    out += same
                else:
                    run = DECAY * run + same
                    after[k, j] = DECAY * after[k - 1, j] + run
        before = after
    return out


def similarities(forms: list[str], landmarks: list[str], own: np.ndarray) -> np.ndarray:
    """Normalised kernel of each form with each landmark; below ``FLOOR`` zero.

    A form is compared with a landmark only if it has all but one of its letters in
    their order (one more may be missing for every eight). A form of up to twice as many
    letters that has them all, with no more than one between any two, has no floor: a letter
    in every gap is as good as none. One of more than ``LONG`` letters that has them nearly
    side by side is measured by the landmark alone.
    """
    out = np.zeros((len(forms), len(landmarks)))
    points, _ = letters_only(code_points(forms))
    alphabet = sorted({ord(c) for x in landmarks for c in x})
    for start in range(0, len(forms), 32768):
        part = points[start : start + 32768]
        part = part[:, : int((part > 0).any(axis=0).sum())]
        held = {c: (part == c).any(axis=1) for c in alphabet}
        close: list[np.ndarray] = []
        whole: list[np.ndarray] = []
        for landmark in landmarks:
            letters = np.array([ord(c) for c in landmark], np.uint32)
            distinct = np.unique(letters)
            maybe = np.flatnonzero(sum(held[c].astype(np.int8) for c in distinct.tolist()) >= min(len(distinct), max(2, len(distinct) - 1)))
            shared = _in_order(part[maybe], letters)
            near = shared >= max(ORDER, len(letters) - 1 - len(letters) // 8)
            close.append(maybe[near])
            whole.append(shared[near] == len(letters))
        which = np.unique(np.concatenate(close)) if close else np.zeros(0, np.int64)
        selves = np.zeros(len(part))
        selves[which] = np.maximum(self_kernel(part[which]), 1e-12)
        for i, (landmark, maybe) in enumerate(zip(landmarks, close, strict=True)):
            if len(maybe):
                chosen = part[maybe]
                chosen = chosen[:, : int((chosen > 0).any(axis=0).sum())]
                k = kernel(chosen, np.array([ord(c) for c in landmark], np.uint32))
                even, held_by = k / np.sqrt(selves[maybe] * own[i]), k / own[i]
                gapped = kernel(np.array([[ord(c) for x in landmark for c in (x, "\0")]], np.uint32), np.array([ord(c) for c in landmark], np.uint32)) / own[i]
                stretched = ((chosen > 0).sum(axis=1) <= 2 * len(landmark)) & _with_single_gaps(chosen, np.array([ord(c) for c in landmark], np.uint32))
                even = np.where(even >= FLOOR, even, 0.0)
                even = np.where(stretched, np.maximum(even, np.minimum(held_by / gapped, 1.0)), np.where(whole[i] & (held_by >= CLEAR) & ((chosen > 0).sum(axis=1) > LONG), np.minimum(held_by, 1.0), even))
                out[start + maybe, i] = even**POWER
    return out


def _in_order(words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How many of the letters each word has in their order (longest common subsequence)."""
    table = np.zeros((len(letters) + 1, len(words)), np.int8)
    for k in range(words.shape[1]):
        diagonal = table[0].copy()
        for j, c in enumerate(letters, 1):
            above = table[j].copy()
            table[j] = np.maximum(np.where(words[:, k] == c, diagonal + 1, above), table[j - 1])
            diagonal = above
    return table[-1]


def _with_single_gaps(words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Whether each word has the letters in order, at most one other letter between two."""
    at = words == letters[0]
    for c in letters[1:]:
        one = np.pad(at, ((0, 0), (1, 0)))[:, :-1]
        at = (words == c) & (one | np.pad(at, ((0, 0), (2, 0)))[:, :-2])
    return at.any(axis=1)


class Scorer:
    """Landmarks, their Nystroem map, and the machine trained on it."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        points = code_points(landmarks) if landmarks else np.zeros((0, 1), np.uint32)
        self.own = self_kernel(points)
        gram = similarities(landmarks, landmarks, self.own) if landmarks else np.zeros((0, 0))
        values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(landmarks)))
        self.map = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
        self.weights, self.bias = np.zeros(len(landmarks)), 0.0
        self.slope, self.offset = 1.0, 0.0

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Text and similarities of every sentence that has any."""
        words = Words(texts, join_letters=True, width=WIDTH)
        if not len(words.at) or not self.landmarks:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        near = similarities(words.forms, self.landmarks, self.own)
        ends = np.array([w[-1] in ".!?" for w in words.forms])
        text = np.repeat(np.arange(len(texts)), words.lengths)
        sentence = np.cumsum(np.concatenate([[0], ends[words.at][:-1]])) + text
        hits = np.flatnonzero((near > 0).any(axis=1)[words.at])
        if not len(hits):
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        # A word counts once, however many of its pieces are similar.
        word = np.cumsum(words.first)[hits]
        own = np.flatnonzero(np.diff(word, prepend=-1))
        of_word, hits = np.maximum.reduceat(near[words.at[hits]], own, axis=0), hits[own]
        cuts = np.flatnonzero(np.diff(sentence[hits], prepend=-1))
        return text[hits][cuts], np.add.reduceat(of_word, cuts, axis=0)

    def decide(self, near: np.ndarray) -> np.ndarray:
        return near @ self.map @ self.weights + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), self.decide(np.zeros((1, len(self.landmarks))))[0])
        text, near = self.sentences(texts)
        np.maximum.at(best, text, self.decide(near))
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Words and word stems that toxic documents hold far more often than others.

    A stem stands for words that begin alike; it is taken instead of them if
    it is found in more toxic documents. What is very similar to a landmark
    already taken, or begins with it, is left out.
    """
    words = Words(texts, join_letters=True)
    index: dict[str, int] = {}
    of_form = []
    for w in words.forms:
        w = "".join(c for c in w if c.isalpha())
        of_form.append([index.setdefault(x, len(index)) for x in {w, *(w[:n] for n in STEMS if n < len(w))} if len(x) >= ORDER])
    sizes = np.array([len(x) for x in of_form], np.int64)
    flat = np.array([i for x in of_form for i in x], np.int64)
    names = list(index)
    text = np.repeat(np.arange(len(texts)), words.lengths)
    seen = np.unique(text * max(1, len(words.forms)) + words.at)
    doc, form = seen // max(1, len(words.forms)), seen % max(1, len(words.forms))
    n = sizes[form]
    at = np.repeat(np.cumsum(sizes)[form] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.unique(np.repeat(doc, n) * max(1, len(names)) + flat[at])
    doc, name = pairs // max(1, len(names)), pairs % max(1, len(names))
    bad = np.bincount(name[toxic[doc] == 1], minlength=len(names)).astype(float)
    good = np.bincount(name[toxic[doc] == 0], minlength=len(names)).astype(float)
    n_bad, n_good = max(1, int((toxic == 1).sum())), max(1, int((toxic == 0).sum()))
    odds = np.log((bad + 0.5) / (n_bad - bad + 0.5)) - np.log((good + 0.5) / (n_good - good + 0.5))
    sure = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    fit = np.flatnonzero((bad >= max(LEAST_DOCUMENTS, n_bad / 60)) & (odds > 3) & (sure > 3))
    chosen: list[str] = []
    extended: dict[str, list[str]] = {}
    for i in fit:
        extended.setdefault(names[i][:-1], []).append(names[i])
    for i in sorted(fit, key=lambda i: (-(bad[i] - bad[i] * good[i] / (good[i] + bad[i])), -len(names[i]), names[i])):
        x = names[i]
        while longer := [n for n in extended.get(x, ()) if bad[index[n]] >= 0.9 * bad[index[x]]]:
            x = max(longer, key=lambda n: bad[index[n]])
        if len(chosen) == most:
            break
        if any(x.startswith(c) or (c.startswith(x) and bad[index[c]] * 1.2 >= bad[i]) for c in chosen):
            continue
        chosen = [c for c in chosen if not c.startswith(x)] + [x]
    return chosen


def bendings(word: str) -> list[str]:
    """The word as a sentence of its own: plain, with a letter doubled, and with letters put in, up to one in every gap."""
    mid = len(word) // 2
    return [word, word[:mid] + word[mid] + word[mid:], word[:mid] + "x" + word[mid:], word[: mid - 1] + "q" + word[mid - 1 : mid + 1] + "z" + word[mid + 1 :], "x".join(word)]


def train(sample: pd.DataFrame, rounds: int = 400, penalty: float = 1e-3, odds: float | None = None) -> Scorer:
    """Fit to ``text, toxic`` rows: the sentence that speaks loudest stands for its document.

    ``odds`` are those of a toxic document where the sample comes from; scores are brought back to them.
    """
    toxic = sample["toxic"].to_numpy(np.int64)
    texts = list(sample["text"])
    scorer = Scorer(choose_landmarks(texts, toxic))
    if not len(sample) or len(np.unique(toxic)) < 2:
        scorer.offset = -3.0 if not len(sample) or toxic[0] == 0 else 3.0
        return scorer
    text, near = scorer.sentences(texts)
    loudest = np.zeros((len(texts), len(scorer.landmarks)))
    if len(text):
        order = np.lexsort((near.sum(axis=1), text))
        loudest[text[order]] = near[order]  # the last one written is the loudest
    bent = scorer.sentences([v for x in scorer.landmarks for v in bendings(x)])[1]
    x = np.concatenate([loudest, bent]) @ scorer.map
    y = np.concatenate([np.where(toxic == 1, 1.0, -1.0), np.ones(len(bent))])
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    for t in range(1, rounds + 1):  # subgradient descent on the hinge loss
        inside = y * (x @ scorer.weights + scorer.bias) < 1
        pull = (weight * y * inside) / len(y)
        rate = 2.0 / np.sqrt(t)
        scorer.weights += rate * (x.T @ pull - penalty * scorer.weights)
        scorer.bias += rate * pull.sum()
    margin = x @ scorer.weights + scorer.bias
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic link, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
        v = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((target - p) * margin).sum(), (target - p).sum()])
        h = np.array([[(v * margin**2).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + 0.5 * step[0], b + 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    shift = np.log(odds * (toxic == 0).sum() / (toxic == 1).sum()) if odds else 0.0
    scorer.slope, scorer.offset = max(float(a), 0.1), float(b + shift)
    return scorer


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: a fifth, by the checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Scorer:
    """The scorer fitted to at most ``per_label`` labelled documents of each kind, held-out ones apart."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = sizes[1] / sizes[0] if sizes.get(0) and sizes.get(1) else None
    return train(training_rows(known, docs, "toxic", per_label), odds=odds)


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts score as a sentence without insult.

    Rows that repeat score alike; very long texts are scored whole, sentence by
    sentence; an empty table gives no rows; other columns, clashing or not, are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scorer, protocol=5))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Scorer = pickle.loads(shipped.value)
        for batch in batches:
            for part in batches_of(batch):
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": model.scores(list(part["text"]))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
