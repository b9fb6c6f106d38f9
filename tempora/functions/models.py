"""Calls of external models in batches, with a fallback row by row, and a cache of their answers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str | None]]
Embedder = Callable[[list[str]], list[list[float]]]


def call(rows: DataFrame, prompt: str, model: Model, out: str = "reply", size: int = 8) -> DataFrame:
    """``rows`` with the model's reply to each prompt.

    Prompts go out ``size`` at a time. A batch whose replies do not match its
    prompts in number is asked again one by one; a call that fails gives null.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` string"

    def ask(prompts: list[str]) -> list[str | None]:
        try:
            replies = model(prompts)
        except Exception:  # noqa: BLE001  a model may fail in any way
            replies = []
        if len(replies) == len(prompts):
            return list(replies)
        return [None] if len(prompts) == 1 else [ask([p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch[prompt].tolist()
            replies = [r for at in range(0, len(prompts), size) for r in ask(prompts[at : at + size])]
            yield batch.assign(**{out: replies})

    return rows.mapInPandas(run, schema)


def request_key(*parts: Column) -> Column:
    """Checksum of what a reply depends on."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def through_cache(rows: DataFrame, cache: DataFrame, prompt: str, model: Model) -> tuple[DataFrame, DataFrame]:
    """Replies of ``rows`` (by ``key``), asked only where ``cache`` (``key, reply``) has none, and the new entries."""
    misses = rows.join(cache, "key", "left_anti").groupBy("key").agg(F.first(prompt).alias(prompt))
    fresh = call(misses, prompt, model).select("key", "reply")
    return rows.join(cache.unionByName(fresh), "key", "left"), fresh


def embed(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding", size: int = 64) -> DataFrame:
    """``rows`` with the vector of each text, scaled to length one; texts go out ``size`` at a time, null ones as empty."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch[text]]
            vectors = [np.asarray(v, np.float64) for at in range(0, len(texts), size) for v in embedder(texts[at : at + size])]
            yield batch.assign(**{out: [(v / (np.linalg.norm(v) or 1.0)).tolist() for v in vectors]})

    return rows.mapInPandas(run, schema)


def stub_embedder(texts: list[str], dim: int = 256) -> list[list[float]]:
    """Counts of a text's tokens by the tail of their checksum (``dim`` divides 4096)."""
    out = []
    for text in texts:
        counts = [0.0] * dim
        for token in re.findall(r"[^\W]+", text.lower()):
            counts[int(hashlib.md5(token.encode()).hexdigest()[-3:], 16) % dim] += 1
        out.append(counts)
    return out
