"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Law ``rows``: shard sizes differ by one row at most. The rows are dealt out
as a uniform random permutation would deal them out:

1. every row falls into a source bucket by its hash;
2. the matrix of how many rows bucket ``p`` sends to block ``b`` is drawn with
   the exact row sums (bucket sizes) and column sums (block sizes): buckets
   are halved again and again, and the left half's share of every block is a
   hypergeometric draw from what its parent holds;
3. each bucket is permuted locally and cut at its row of the matrix;
4. rows are exchanged, and each block is permuted locally again.

A block is a run of slots of one shard, so no task holds more than a block,
however large a shard is. All of it is DataFrame operations; the matrix is
drawn inside Catalyst expressions and nothing is collected but two counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tempora.llm.common import durable, text_bytes, unit_uniform

ROW_OVERHEAD = 8


def _mode_window(total: Column, good: Column, draws: Column) -> tuple[Column, Column]:
    """Support of a hypergeometric draw, cut 12 deviations (and 30 rows) off its mode.

    What lies beyond has less weight than the last bit of a double.
    """
    n, k, d = total.cast("double"), good.cast("double"), draws.cast("double")
    var = d * k / F.greatest(n, F.lit(1.0)) * (1 - k / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0))
    reach = F.ceil(F.sqrt(F.greatest(var, F.lit(0.0))) * 12).cast("long") + 30
    mode = F.floor((d + 1) * (k + 1) / (n + 2)).cast("long")
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good), mode - reach)
    high = F.least(draws, good, mode + reach)
    return low, F.greatest(low, high)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not once for each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of good rows among ``draws`` of ``total``: the inverse distribution at ``u``.

    Weights follow from the ratio of neighbouring terms, so there is no
    factorial to lose digits in.
    """
    low, high = _mode_window(total, good, draws)
    given = F.struct(low.alias("low"), high.alias("high"), total.alias("total"), good.alias("good"), draws.alias("draws"), u.alias("u"))

    def draw(g: Column) -> Column:
        def ratio(k: Column) -> Column:
            up = (g["good"] - k).cast("double") * (g["draws"] - k).cast("double")
            return up / ((k + 1).cast("double") * (g["total"] - g["good"] - g["draws"] + k + 1).cast("double"))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        mass = F.aggregate(F.sequence(g["low"], g["high"]), start, lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])

        def search(goal: Column) -> Column:
            first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), g["low"].alias("at"))

            def step(a: Column, k: Column) -> Column:
                after = a["sum"] + a["w"]
                return F.struct((a["w"] * ratio(k)).alias("w"), after.alias("sum"), F.when(after <= goal, F.least(k + 1, g["high"])).otherwise(a["at"]).alias("at"))

            return F.aggregate(F.sequence(g["low"], g["high"]), first, step, lambda a: a["at"])

        return _bind(g["u"] * mass, search)

    certain = F.when(draws <= 0, F.lit(0).cast("long")).when(good <= 0, F.lit(0).cast("long")).when(draws >= total, good).when(good >= total, draws)
    return certain.otherwise(_bind(given, draw))


_DRAW = T.StructType([T.StructField("rest", T.LongType()), T.StructField("need", T.LongType()), T.StructField("out", T.ArrayType(T.LongType()))])


def _draw_row(caps: Column, need: Column, seed: int, node: Column) -> Column:
    """A multivariate hypergeometric draw of ``need`` rows from blocks that hold ``caps``."""
    total = F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x)
    zero = F.struct(total.alias("rest"), need.alias("need"), F.array().cast("array<bigint>").alias("out")).cast(_DRAW)

    def step(a: Column, c: Column) -> Column:
        u = unit_uniform(F.lit(seed), node, F.size(a["out"]))

        def after(k: Column) -> Column:
            return F.struct((a["rest"] - c).alias("rest"), (a["need"] - k).alias("need"), F.concat(a["out"], F.array(k)).alias("out")).cast(_DRAW)

        return _bind(hypergeometric(a["rest"], c, a["need"], u).cast("long"), after)

    return F.aggregate(caps, zero, step, lambda a: a["out"])


def communication_matrix(counts: DataFrame, buckets: int, block_rows: list[int], seed: int) -> DataFrame:
    """Rows ``bucket, sends``: how many rows each bucket sends to each block.

    ``counts`` has ``bucket`` (0 to ``buckets`` - 1, a power of two; absent: no
    rows) and ``n``. Row and column sums are exact.
    """
    full = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    held = F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n")))), lambda x: x["n"])
    caps = F.array(*[F.lit(x).cast("long") for x in block_rows]) if len(block_rows) <= 64 else F.expr(f"array({','.join(f'{x}L' for x in block_rows)})")
    nodes = full.agg(held.alias("held")).select(F.lit(0).cast("int").alias("first"), "held", caps.alias("caps"))
    width, level = buckets, 0
    while width > 1:
        half = width // 2
        left_held, right_held = F.slice("held", 1, half), F.slice("held", half + 1, half)
        need = F.aggregate(left_held, F.lit(0).cast("long"), lambda a, x: a + x)
        nodes = nodes.withColumn("left", _draw_row(F.col("caps"), need, seed, F.concat_ws("/", F.lit(width), F.col("first"))))
        nodes = nodes.select(
            F.explode(
                F.array(
                    F.struct(F.col("first"), left_held.alias("held"), F.col("left").alias("caps")),
                    F.struct((F.col("first") + half).alias("first"), right_held.alias("held"), F.zip_with("caps", "left", lambda c, x: c - x).alias("caps")),
                )
            ).alias("x")
        ).select("x.*")
        level += 1
        if level == 5 and width > 2:  # the subtrees draw side by side from here on
            nodes = nodes.repartition("first")
        width = half
    return nodes.select(F.col("first").alias("bucket"), F.col("caps").alias("sends"))


def _power_of_two(least: int) -> int:
    return 1 << max(0, int(least) - 1).bit_length()


def uniform_shards(docs: DataFrame, shards: int = 24, seed: int = 42, task_rows: int = 1 << 18, most_blocks: int = 4096) -> DataFrame:
    """Deal all rows of ``docs`` (``doc_id``, ``text``) into shards, uniformly, sizes exact.

    Returns ``doc_id, size, text_crc32, shard, slot``. ``task_rows`` is what a
    bucket or a block holds, as long as ``most_blocks`` of them are enough;
    beyond, both grow and their sorts spill.

    Null texts have size 8 and the checksum of the empty text; a null
    ``doc_id`` is a value like any other. Equal rows share a bucket and are
    interchangeable, so their order is no matter. An empty table gives no
    rows. Other columns are ignored.
    """
    slim = docs.select("doc_id", (text_bytes(docs) + ROW_OVERHEAD).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    slim = durable(slim)
    rows = slim.count()
    buckets = min(most_blocks, _power_of_two(max(16, -(-rows // task_rows))))
    per_shard = [rows // shards + (s < rows % shards) for s in range(shards)]
    cuts = max(1, min(most_blocks // shards, -(-rows // (task_rows * shards))))
    blocks = [(s, c, n // cuts + (c < n % cuts)) for s, n in enumerate(per_shard) for c in range(cuts)]
    first_slot: list[int] = []
    for s, c, n in blocks:
        first_slot.append(0 if c == 0 else first_slot[-1] + blocks[len(first_slot) - 1][2])

    identity = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    dealt = slim.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(counts, buckets, [n for _, _, n in blocks], seed)

    # A marker row stands where a bucket's share of a block begins; a running maximum carries it on.
    marks = matrix.select("bucket", F.posexplode("sends").alias("block", "n"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select("bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("at"), F.lit(0).alias("is_row"), "block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("text_crc32"))
    local = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), *identity), *identity)
    placed = dealt.select("bucket", F.row_number().over(local).cast("long").alias("at"), F.lit(1).alias("is_row"), F.lit(None).cast("int").alias("block"), F.col("doc_id").cast("long"), "size", "text_crc32")
    carried = Window.partitionBy("bucket").orderBy("at", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    sent = placed.unionByName(marks).withColumn("block", F.max("block").over(carried)).where("is_row = 1").select("block", "doc_id", "size", "text_crc32")

    again = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 2), *identity), *identity)
    starts = F.array(*[F.lit(x).cast("long") for x in first_slot]) if len(first_slot) <= 64 else F.expr(f"array({','.join(f'{x}L' for x in first_slot)})")
    return sent.select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(F.col("block") / cuts).cast("int").alias("shard"),
        (F.row_number().over(again) - 1 + F.element_at(starts, F.col("block") + 1)).cast("long").alias("slot"),
    )
