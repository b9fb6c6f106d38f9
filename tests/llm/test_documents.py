"""Operators on documents against brute force, on a fixture of odd texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempora.llm import bpe, linededup, packing, sharding, simhash, suffixarray

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


# -- suffix arrays ---------------------------------------------------------------


def test_suffix_array_is_sorted():
    rnd = random.Random(3)
    for _ in range(800):
        x = [rnd.randrange(rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(0, 40))]
        assert suffixarray.suffix_array(np.array(x, np.int64)) == sorted(range(len(x)), key=lambda i: x[i:])


def repeats(rows, length):
    seen = Counter(t[a : a + length] for _, t in rows for a in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def got_repeats(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()]


def test_repeats_of_tricky_documents(tricky):
    small = tricky.where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    rows = [(r.doc_id, (r.text or "").encode()) for r in small.collect()]
    cut = suffixarray.remove_repeats(small)
    assert sorted(got_repeats(cut), key=repr) == sorted(repeats(rows, 400), key=repr)
    assert [c for c in cut.columns if c in small.columns] == small.columns


@pytest.mark.parametrize("most_blocks", [256, 1])
def test_repeats_at_random(spark, most_blocks):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ab c") for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(60):
        s = list(rnd.choice(base) + rnd.choice(base))
        s[rnd.randrange(len(s))] = rnd.choice("zé")
        rows.append((i, "".join(s)))
    rows += [(100, "a" * 70), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = repeats([(i, t.encode()) for i, t in rows], 20)
    assert sorted(got_repeats(suffixarray.remove_repeats(df, 20, 8, most_blocks))) == sorted(want)


# -- lines -----------------------------------------------------------------------


def test_perfect_hash_is_minimal_and_survives_storage():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000)).astype(np.uint64)
    made = linededup.PerfectHash.build(keys)
    assert sorted(made.index(keys)) == list(range(len(keys)))
    assert (linededup.PerfectHash.load(made.dump()).index(keys) == made.index(keys)).all()
    assert len(linededup.PerfectHash.build(keys[:0]).index(keys[:3])) == 3


def test_lines(monkeypatch, tricky):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    low, blank = str.maketrans(linededup.UPPER, linededup.LOWER), linededup.BLANK
    holders = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {x.translate(low).strip(blank) for x in (t or "").split("\n")}:
            holders[k].append(-1 if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := x.translate(low).strip(blank)) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != i)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for shard_keys, probes in ((1 << 17, 1 << 16), (1, 2)):
        monkeypatch.setattr(linededup.copies_of, "__defaults__", (probes,))
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.drop_lines(tricky, shard_keys=shard_keys).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# -- fingerprints ----------------------------------------------------------------


def slow_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(tricky):
    for t in [r.text for r in tricky.collect()][:14]:
        if len(t or "") < 5000:
            assert simhash.fingerprint(t) == slow_fingerprint(t, 3)


@pytest.mark.parametrize("at_once", [2048, 1])
def test_all_links_are_found(monkeypatch, at_once):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, near]))
    want = {(int(a), int(b)) for a in fps for b in fps if a != b and int(a ^ b).bit_count() <= 2}
    at, anchor, home = simhash.anchors(fps.view(np.int64), 2)
    found = set()
    for c in np.unique(anchor[home]):
        here = anchor == c
        a, b = simhash.near_pairs(fps[at[here & home]].view(np.int64), fps[at[here]].view(np.int64), 2)
        found |= {(int(x), int(y)) for p, q in zip(a.view(np.uint64), b.view(np.uint64), strict=True) for x, y in ((p, q), (q, p))}
    assert found == want


def test_components_of_tricky_documents(tricky):
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in tricky.collect()]
    groups = {n: n for n in range(len(rows))}

    def find(n):
        return n if groups[n] == n else find(groups[n])

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= 2:
                groups[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)].append(d)
    want = sorted(((d, min(names[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(tricky).collect()), key=repr)
    assert got == want


def test_edges_that_no_other_block_shares_are_not_ordered():
    rnd = random.Random(5)
    for window in (1, 2, 5, 64):
        ordered = given = 0
        for _ in range(40):
            left, right = (bytes(rnd.choice(b"ab") for _ in range(window - 1)) for _ in range(2))
            blocks = {(left, right), (left[len(left) // 2 :], right), (left, right[: len(right) // 2])}
            for _ in range(rnd.randrange(1, 7)):
                i, j = rnd.randrange(window), rnd.randrange(window)
                blocks.add((b"x" * (len(left) - i) + left[len(left) - i :], right[:j] + b"y" * (len(right) - j)))
            blocks = sorted(blocks)
            want = {}
            for k, (a, b) in enumerate(blocks):
                strings = [{o: (a[len(a) - o :], b[: window - 1 - o]) for o in range(window) if o <= len(a) and window - 1 - o <= len(b)} for a, b in blocks]
                own = [o for o, x in strings[k].items() if any(strings[other].get(o) == x for other in range(len(blocks)) if other != k)]
                if own:
                    want[k] = own
            short = suffixarray.trimmed(blocks, window)
            offsets = suffixarray.repeated_offsets([(0, a, b) for _, a, b in short], window) if short else []
            assert {k: sorted(own) for (k, _, _), own in zip(short, offsets, strict=True) if own} == want
            given += sum(len(a) + len(b) for a, b in blocks)
            ordered += sum(len(a) + len(b) for _, a, b in short)
        assert window == 1 or ordered < given


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(1)
    words = [f"w{i}{rnd.randrange(999)}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(400)]
        rows.append((100 * g, " ".join(base)))
        for c in range(3):
            copy = base.copy()
            copy[rnd.randrange(400)] = "changed"
            rows.append((100 * g + 1 + c, " ".join(copy)))
        far = base.copy()
        for k in range(0, 400, 20):
            far[k] = f"other{k}"
        rows.append((100 * g + 9, " ".join(far)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i % 100 in (0, 9))


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 30])
def test_only_texts_that_share_heads_meet(spark, monkeypatch, bucket_rows):
    """Unrelated texts go to no anchor, so that what is sent does not grow with the square of their number."""
    rng = np.random.default_rng(6)
    marks = rng.integers(0, 1 << 64, (3000, simhash.PARTS), np.uint64)
    heads = rng.integers(-(1 << 62), 1 << 62, (3000, len(simhash.HEADS)))
    marks[2000:2100] = marks[0]  # near copies, and others that share a head with them alone
    marks[2000:2100, 12] ^= np.uint64(1) << np.arange(100).astype(np.uint64) % np.uint64(64)
    marks[2000:2100, 11] ^= np.arange(100).astype(np.uint64)
    heads[2000:2100, :6] = heads[0, :6]
    heads[2100:2200, 5] = heads[0, 5]
    marks[2300], heads[2300, 3] = marks[2301], heads[2301, 3]
    marks[2300, 0] ^= np.uint64(5)
    sent = []
    for name in ("similar_classes", "bitmap"):
        real = getattr(simhash, name)
        monkeypatch.setattr(simhash, name, lambda df, *rest, real=real: sent.append(df.count()) or real(df, *rest))
    rows = [(i, m.tobytes(), *map(int, h)) for i, (m, h) in enumerate(zip(marks, heads, strict=True))]
    df = spark.createDataFrame(rows, ", ".join(["node long, mark binary", *(f"{c} long" for c in simhash.HEADS)]))
    found = {r.node: r.root for r in simhash.similar_texts(df, 150, 2, bucket_rows).collect()}
    assert found == dict.fromkeys(range(2000, 2100), 0) | {2301: 2300}
    assert sent == [] if bucket_rows > 30 else sent[0] == 201


def test_unrelated_texts_are_sent_to_no_anchor(spark, monkeypatch):
    sent = []
    real = simhash.visitor_links
    monkeypatch.setattr(simhash, "visitor_links", lambda nodes, *rest: sent.append(nodes.count()) or real(nodes, *rest))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(300)]
    rows += [(1000 + i, f"{text} more") for i, text in rows[:50]]
    kept = sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == list(range(300))
    assert sum(sent) == 0


@pytest.mark.parametrize("cell_rows", [4096, 40])
def test_a_large_cell_loses_no_link(spark, cell_rows):
    """Two groups whose members differ from the other group's by more bits than allowed, with a bridge between them."""
    rng = np.random.default_rng(3)
    bits = 64 * simhash.PARTS
    free = np.arange(simhash.TABLES * 2 * simhash.BLOCK, bits)  # bits that no table looks at
    rows = np.zeros((600, bits), np.uint8)
    for row in rows[1:400]:
        row[rng.choice(np.arange(1, bits), 3, replace=False)] = 1
    rows[400:500, :46] = rng.integers(0, 2, 46)
    rows[400:500, 46:400] = 1
    for row in rows[400:500]:
        row[rng.choice(np.arange(500, bits), 3, replace=False)] ^= 1
    rows[500:] = rng.integers(0, 2, (100, bits))
    assert len(free) < bits
    marks = [np.packbits(r, bitorder="little").tobytes() for r in rows]
    most = 60
    df = spark.createDataFrame(list(enumerate(marks)), "node long, mark binary")
    found = {r.node: r.root for r in simhash.similar_classes(df, most, 2, cell_rows).collect()}
    assert {found.get(i, i) for i in range(400)} == {0}
    assert {found.get(i, i) for i in range(400, 500)} == {400}
    assert not any(i in found for i in range(500, 600))


def test_links_put_out_grow_with_nodes_not_pairs(spark):
    rng = np.random.default_rng(4)
    rows = np.zeros((1500, 64 * simhash.PARTS), np.uint8)
    for row in rows:
        row[rng.choice(rows.shape[1], 20, replace=False)] = 1
    df = spark.createDataFrame([(i, np.packbits(r, bitorder="little").tobytes()) for i, r in enumerate(rows)], "node long, mark binary")
    shared = simhash.home_cells(df).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    assert simhash.home_links(df, shared, simhash.bitmap(shared), 100).count() <= 1500 * simhash.TABLES
    one = df.withColumn("root", F.lit(7).cast("long")).select("root", "mark")
    assert simhash.visitor_links(one, shared, simhash.bitmap(simhash.home_cells(df)), 100, 2).count() == 0


def test_unlike_texts_stay(spark):
    """Half of the shingles in common, or fewer: everything stays."""
    rnd = random.Random(6)
    rows = []
    for i in range(200):
        body = [f"w{rnd.randrange(10**9)}" for _ in range(200)]
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(body[:150] + [f"v{rnd.randrange(10**9)}" for _ in range(60)]))]  # J 0.56
    assert simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).count() == 400


def test_copies_with_a_quarter_appended_are_found(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        body = [f"w{rnd.randrange(10**9)}" for _ in range(304)]
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(body + [f"v{rnd.randrange(10**9)}" for _ in range(74 - i % 10)]))]  # J 0.80 to 0.82
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(r.doc_id % 2 for r in kept.select("doc_id").collect()) <= 6


# -- tokens ----------------------------------------------------------------------


def test_bpe_tree_equals_the_library_and_decodes(tricky):
    encoding = bpe.load_ranks(MULTI, public_tokenizers.PATTERN)
    rows = {(r.doc_id, r.text) for r in tricky.collect()}
    got = {(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(tricky, MULTI, public_tokenizers.PATTERN, leaf=16).collect()}
    assert got == {(i, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows}


def test_bpe_tree_on_odd_texts():
    encoding = bpe.load_ranks(MULTI, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    for _ in range(1500):
        t = "".join(rnd.choice(" \n\t.,'’aéßs中   x1²—ll\x1c　don't") for _ in range(rnd.randint(0, 60)))
        assert bpe.encode_tree(encoding, t, rnd.choice([1, 2, 3, 8])) == encoding.encode_ordinary(t)
    other = bpe.load_ranks(MULTI, r"\w+|\W")  # a pattern without sure places
    for _ in range(200):
        t = "".join(rnd.choice(" \n\t.,'aéßsx1don't") for _ in range(rnd.randint(0, 40)))
        assert bpe.encode_tree(other, t, 3) == other.encode_ordinary(t)


def test_packing_is_gapless_and_whole(tricky):
    tokenizer = Tokenizer.from_file(JSON)
    rows = packing.pack_documents(tricky, JSON).toPandas()
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in tricky.collect())
    for doc_id, ids in want:
        n = want[doc_id, ids]
        own = rows[rows.doc_id.isna() if doc_id is None else rows.doc_id == doc_id].sort_values("start")
        assert own.length.sum() == n * len(ids) and set(own.doc_tokens) == {len(ids)}
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= s.tier.iloc[0] <= 1024
    steps = rows.drop_duplicates("sequence_id").groupby("step_group").tier.sum()
    assert (steps <= packing.STEP_TOKENS).all() and (steps < packing.STEP_TOKENS).sum() <= 6 * tricky.rdd.getNumPartitions()
    padded = rows.groupby("sequence_id").agg(used=("length", "sum"), tier=("tier", "first"))
    assert (padded.tier - padded.used).gt(0).sum() <= tricky.rdd.getNumPartitions()


def test_steps_are_exact():
    rnd, steps, sums = random.Random(2), packing.Steps(8192), Counter()
    for _ in range(5000):
        tier = rnd.choice(packing.TIERS)
        sums[steps.place(tier)] += tier
    assert sum(v != 8192 for v in sums.values()) <= 6 and max(sums.values()) == 8192


def test_packing_reads_special_tokens_and_odd_spaces_as_the_tokenizer_does():
    tokenizer, encoder = Tokenizer.from_file(JSON), packing.WordEncoder(JSON)
    for t in ("a <|endoftext|> b", "a  b   c", "x y", "tab\t end ", "  lead"):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# -- shards ----------------------------------------------------------------------


def test_shards_are_exact(tricky):
    rows = sharding.uniform_shards(tricky, 5, task_rows=2).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == tricky.count() and sizes.max() - sizes.min() <= 1 and len(sizes) == 5
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in rows.groupby("shard"))
    want = sorted((zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in tricky.collect())
    assert sorted(zip(rows.text_crc32, rows["size"], strict=True)) == want


def test_shards_are_uniform(spark):
    """Counts of source and shard follow a hypergeometric spread, and neighbours part."""
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharding.uniform_shards(df, 4).toPandas()
    low = rows[rows.doc_id < 10000].groupby("shard").size()
    assert (abs(low - 2500) < 6 * np.sqrt(2500 * 0.75 * 0.5)).all()
    assert abs(np.corrcoef(rows.doc_id, rows.slot)[0, 1]) < 0.05


def test_hypergeometric_draws(spark):
    from tempora.llm.common import unit_uniform

    n, good, draws = (F.lit(x).cast("long") for x in (1000, 300, 100))
    k = spark.range(4000).select(sharding.hypergeometric(n, good, draws, unit_uniform(F.lit(1), F.col("id"))).alias("k")).toPandas().k
    assert abs(k.mean() - 30) < 0.4 and abs(k.std() - 4.35) < 0.3
    matrix = sharding.communication_matrix(spark.createDataFrame([(0, 7), (2, 3), (3, 0)], "bucket int, n long"), 4, [4, 4, 2], 1).collect()
    assert [sum(r.sends) for r in sorted(matrix, key=lambda r: r.bucket)] == [7, 0, 3, 0]
    assert [sum(r.sends[j] for r in matrix) for j in range(3)] == [4, 4, 2]


# -- empty tables ----------------------------------------------------------------


def test_empty_tables(nothing):
    assert suffixarray.remove_repeats(nothing).count() == 0
    assert linededup.drop_lines(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_first(nothing).count() == 0
    assert bpe.digest_documents(nothing, MULTI, public_tokenizers.PATTERN).count() == 0
    assert packing.pack_documents(nothing, JSON).count() == 0
    assert sharding.uniform_shards(nothing, 3).count() == 0


def test_digests(tricky):
    row = bpe.digest_documents(tricky.where("doc_id = 3"), MULTI, public_tokenizers.PATTERN).first()
    assert row.decoded_sha256 == hashlib.sha256(b"one").hexdigest()
