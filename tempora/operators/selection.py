"""Budgeted selection of frames by score, diversity and adaptive segments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DEPTH = 5
SPREAD = 0.8


def minmax(score: str, group: str, flat: float = 0.0, least: float = 0.0) -> Column:
    """Scores scaled to 0..1 in their group; ``flat`` where their span is ``least`` or less."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low > least, (F.col(score) - low) / (high - low)).otherwise(F.lit(flat))


def halvings(index: Column, n: Column) -> Column:
    """The ranges that hold an index when ``0..n`` is halved, down to ``DEPTH``: an array of ``depth, lo, hi``."""
    node = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    root = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi")).cast(node)

    def step(path: Column, d: Column) -> Column:
        last = F.element_at(path, -1)
        mid = last["lo"] + F.floor((last["hi"] - last["lo"]) / 2).cast("long")
        left = index < mid
        child = F.struct(d.alias("depth"), F.when(left, last["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(last["hi"]).alias("hi")).cast(node)
        return F.when((last["depth"] == d - 1) & (last["hi"] - last["lo"] >= 2), F.concat(path, F.array(child))).otherwise(path)

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(root), step)


def adaptive_keyframes(scored: DataFrame, k: int | str, group: str = "video_id", index: str = "frame_index") -> DataFrame:
    """``k`` frames of each group (``score`` scaled to 0..1): halves are split until their peak stands out.

    A range is a leaf if the mean of its ``k`` best scores exceeds its mean by
    more than ``SPREAD``, or it is at the last depth, or has one frame. A leaf
    gives its ``k // 2**depth`` best; what is missing is filled with the best
    of the rest. Groups of ``k`` frames or fewer are taken whole. ``k`` may be a
    column that is constant in a group.

    Each frame lists the ranges that hold it, so the ranges are ranked in one
    pass; a frame then keeps its topmost leaf alone.
    """
    base = scored.select(group, index, "score", (F.lit(k) if isinstance(k, int) else F.col(k)).cast("long").alias("_k"))
    base = base.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    members = base.select("*", F.explode(halvings(F.col(index), F.col("_n"))).alias("_range")).select(group, index, "score", "_k", "_n", "_range.*")
    node = Window.partitionBy(group, "depth", "lo", "hi")
    ranked = members.withColumn("_r", F.row_number().over(node.orderBy(F.desc("score"), index)))
    peak = F.avg(F.when(F.col("_r") <= F.col("_k"), F.col("score"))).over(node)
    leaf = (F.round(peak - F.avg("score").over(node), 9) > SPREAD) | (F.col("depth") == DEPTH) | (F.col("hi") - F.col("lo") < 2)
    top = F.min(F.when(F.col("_leaf"), F.struct("depth", "_r")))
    frames = ranked.withColumn("_leaf", leaf).groupBy(group, index, "score", "_k", "_n").agg(top.alias("_top"))
    taken = F.col("_top._r") <= F.floor(F.col("_k") / F.pow(F.lit(2.0), F.col("_top.depth")))
    frames = frames.withColumn("_taken", taken).withColumn("_have", F.sum(F.col("_taken").cast("long")).over(Window.partitionBy(group)))
    rest = F.row_number().over(Window.partitionBy(group, "_taken").orderBy(F.desc("score"), index))
    kept = (F.col("_n") <= F.col("_k")) | F.col("_taken") | (rest <= F.col("_k") - F.col("_have"))
    return frames.withColumn("_kept", kept).where("_kept").select(group, index)


def mmr(frames: DataFrame, k: int, weight: float, schema: str, *group: str) -> DataFrame:
    """Greedy maximal marginal relevance in each group (``frame_index, embedding, relevance``).

    Each pick depends on those before it, so a group is one array program; its
    state is one number for each frame. Groups are videos or parts of them, whose length is bounded.
    """

    def pick(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("frame_index")
        x, rel = np.stack(batch["embedding"]).astype(np.float64), batch["relevance"].to_numpy()
        chosen = [int(np.argmax(np.round(rel, 12)))]
        worst = x @ x[chosen[0]]
        while len(chosen) < min(k, len(x)):
            gain = weight * rel - (1 - weight) * worst
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(np.round(gain, 12))))
            worst = np.maximum(worst, x @ x[chosen[-1]])
        return pd.DataFrame({**{g: batch[g].iloc[0] for g in group}, "frame_index": batch["frame_index"].to_numpy()[chosen], "pick": range(1, len(chosen) + 1)})

    return frames.groupBy(*group).applyInPandas(pick, schema)


def span_decay(t: Column, spans: Column, margin: float = 5.0) -> Column:
    """Navigation score of a time against an array of spans: 1 inside, fading over the margin, 0 beyond."""
    def one(s: Column) -> Column:
        out = F.greatest(F.lit(0.0), s["lo"] - t, t - s["hi"])
        return F.when(out == 0, F.lit(1.0)).when(out <= margin, 0.5 * (1 - out / (margin + 1))).otherwise(0.0)

    return F.aggregate(F.transform(spans, one), F.lit(0.0), lambda a, x: F.greatest(a, x))


Selector = Callable[[DataFrame, int], DataFrame]
#: Selectors by name; programs register their own.
SELECTORS: dict[str, Selector] = {}


def register(name: str, selector: Selector) -> None:
    """Add a selector: frames with ``video_id, frame_index, n`` and a budget give the chosen indexes."""
    if name in SELECTORS:
        raise ValueError(f"a selector named {name} exists")
    SELECTORS[name] = selector


def discover(skip: tuple[str, ...] = ()) -> list[str]:
    """Names of all selectors, sorted, without those to skip."""
    return sorted(set(SELECTORS) - set(skip))


def load(name: str) -> Selector:
    """The selector of a name; an unknown one is an error that lists those there are."""
    if name not in SELECTORS:
        raise KeyError(f"no selector {name}; there are {', '.join(discover())}")
    return SELECTORS[name]


def run_program(frames: DataFrame, questions: DataFrame, build: Callable[[DataFrame], DataFrame], select: Selector, answer: Callable[[Column], Column], budget: int) -> DataFrame:
    """``video_id, prediction, frames``: a program from its parts.

    ``build`` turns frames into a memory (the frames it keeps, with what it adds
    to them), ``select`` picks frames of it within the budget, and ``answer``
    reads the captions of those shown, in order. Videos without frames get ``?``.
    """
    memory = build(frames)
    shown = memory.join(select(memory, budget), ["video_id", "frame_index"], "left_semi")
    context = shown.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "caption"))), lambda x: x["caption"]), "\n").alias("context"), F.count(F.lit(1)).alias("frames"))
    told = questions.join(context, "video_id", "left")
    return told.select("video_id", F.when(F.col("context").isNull(), "?").otherwise(answer(F.col("context"))).alias("prediction"), F.coalesce("frames", F.lit(0)).alias("frames"))
