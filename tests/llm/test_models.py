"""Vectors, languages and toxicity: recall, held-out accuracy, and odd rows."""

import numpy as np
import pytest

from tempora.llm import capfilter, langid, toxicity, vptree
from tempora.llm.components import components


@pytest.fixture(scope="session")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    rows = []
    for i, v in enumerate(base):
        rows.append((3 * i, v.tolist(), i % 3))
        rows.append((3 * i + 1, (v + 0.03 * rng.standard_normal(16)).tolist(), i % 3))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 1), (1002, None, 0), (1003, [], 0), (1004, [0.0] * 16, 0), (1005, [float("nan")] * 16, 0), (1006, [None] + [1.0] * 15, 0), (1007, rows[0][1], None), (1008, [1.0, 2.0], 0), (1009, [2.0, 4.0], 0), (1010, [float("inf")] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (0.4, 0.9)])
def test_search(vectors, factor, least):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if usable(r.embedding)]
    got = vptree.nearest(vectors, vectors.where("vec_id % 10 = 0"), 5, factor, shard_rows=64, block_queries=7).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    hits = total = 0
    for q, v in rows:
        if q % 10:
            continue
        near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))[:5]
        for k, (d, i) in enumerate(near, 1):
            total += 1
            hits += (q, k) in found and found[q, k][1] <= d + 1e-9
    assert hits >= least * total


def test_repeated_queries_are_asked_once(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = df.where("vec_id = 5").union(df.where("vec_id = 5")).union(spark.createDataFrame([(5, [7.0, 1.0], 0)], df.schema))
    got = vptree.nearest(df, asked, 4, 1.0, shard_rows=8).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and [r.vec_id for r in got] == [4, 6, 3, 7]


def test_vectors_of_odd_tables(spark, vectors):
    """Empty tables, and further columns named like those used inside."""
    empty = vectors.limit(0)
    assert vptree.nearest(empty, empty).count() == 0 and capfilter.near_duplicates(empty).count() == 0
    assert vptree.nearest(vectors, empty).count() == 0 and vptree.nearest(empty, vectors).count() == 0
    clashing = vectors.selectExpr("*", "1 AS shard", "2 AS tree", "3 AS dims", "4 AS rank", "5 AS filter", "6 AS n", "7 AS h", "8 AS kept", "9 AS copies")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert same(vptree.nearest(clashing, clashing, 3, 1.0), vptree.nearest(vectors, vectors, 3, 1.0))
    assert same(capfilter.near_duplicates(clashing), capfilter.near_duplicates(vectors))


def test_near_vectors(vectors):
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    want_links, groups = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        return i if groups[i] == i else find(groups[i])

    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    want_links[i] += 1
                    want_links[j] += 1
                    lo, hi = sorted((find(i), find(j)))
                    groups[hi] = lo
    for chunk in (2048, 1):
        got = {r.vec_id: r for r in capfilter.near_duplicates(vectors, chunk=chunk).collect()}
        wrong = [i for i in want_links if got[i].n_links != want_links[i] or got[i].component_id != find(i) or got[i].kept != (find(i) == i)]
        assert len(got) == len(rows) and len(wrong) <= 0.02 * len(rows)
        assert all(got[i].n_links <= want_links[i] for i in want_links)
        assert got[1004].n_links == got[1005].n_links == got[1007].n_links == 0


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sentences(rng, stems, n):
    return " ".join(f"{rng.choice(stems)}{rng.choice(['ing', 'er', 'o', 'a', 'en'])}" for _ in range(n))


@pytest.fixture(scope="session")
def spoken(spark):
    rng = np.random.default_rng(6)
    stems = {"xx": ["scha", "lich", "keit", "und"], "yy": ["mente", "cio", "que", "para"]}
    rows = []
    for i in range(240):
        lang = "xx" if i % 2 else "yy"
        text = sentences(rng, stems[lang], 12)
        if i % 6 == 0:
            text += f" you {('blorgo', 'snarfel')[i % 4 // 2]} there."
        rows.append((i, text, lang, int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_languages(spoken, tricky, nothing):
    got = langid.identify(spoken).toPandas().merge(spoken.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert 30 < len(held) < 90 and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    field = langid.learn(spoken)
    odd = {r.doc_id: r for r in langid.predict_languages(tricky, field).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[3].lang_pred in ("xx", "yy")
    kept = langid.filter_languages(tricky, field)
    assert kept.columns == tricky.columns and {0, 1, 2}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == tricky.count() - 3
    assert langid.identify(nothing).count() == 0


def test_forward_backward_agrees_with_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    scores, steps, first = rng.standard_normal((4, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(first[path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            want[t, y] += w
    got = langid.marginals(*langid.forward_backward(scores, np.array([4]), steps, first)[:2])
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_kernel_agrees_with_enumeration():
    from itertools import combinations

    from tempora.llm.words import code_points

    def slow(s, t):
        return sum(toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1) for i in combinations(range(len(s)), 3) for j in combinations(range(len(t)), 3) if [s[x] for x in i] == [t[x] for x in j])

    words = ["idiot", "id-iot", "radio", "ab", "ttiiddoo"]
    got = toxicity.kernel(code_points(words), np.array([ord(c) for c in "idiot"], np.uint32))
    assert np.allclose(got, [slow(w, "idiot") for w in words])
    assert np.allclose(toxicity.self_kernel(code_points(words)), [slow(w, w) for w in words])


def test_toxicity(spoken, tricky, nothing):
    labels = spoken.select("doc_id", "toxic")
    scorer = toxicity.learn(spoken, labels)
    got = toxicity.score_documents(spoken, scorer).withColumn("held_out", toxicity.held_out()).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.95
    bent = scorer.scores(["you blor-go", "b l o r g o here", "snarrfel you", None, "", "clean words"])
    assert (bent[:3] >= 0.5).all() and (bent[3:] < 0.5).all()
    odd = toxicity.score_documents(tricky, scorer).toPandas()
    assert len(odd) == tricky.count() and odd.score.between(0, 1).all()
    assert toxicity.score_documents(nothing, toxicity.learn(nothing, labels.limit(0))).count() == 0


def test_long_words_are_read_whole():
    import pandas as pd

    from tempora.llm.words import Words, pieces

    digits = "1" * 25
    sample = pd.DataFrame({"text": ["the cat sat on the mat and went home"] * 9 + ["le chat est sur la table et il dort"] * 9, "lang": ["en"] * 9 + ["fr"] * 9})
    field = langid.train(sample)
    assert langid.label(field, [digits + "thecatsatonthemat" + digits, digits * 3])[0].tolist()[0] < 2
    assert langid.label(field, [digits * 3])[0].tolist() == [2]
    assert "q" in "".join(pieces("a" * 500 + "q" + "a" * 500, 40)) and len(Words(["ab" * 400 + "."]).forms[-1]) <= 40
    toxic = ["you are an idiot", "what an idiot he is", "idiot and moron", "go away moron", "such a moron"] * 8
    clean = ["the cat sat on the mat", "we went home at night", "a fine day for a walk"] * 14
    scorer = toxicity.train(pd.DataFrame({"text": toxic + clean, "toxic": [1] * len(toxic) + [0] * len(clean)}))
    filler = "wehavegonehometoday" * 4
    plain, inside = scorer.scores([filler + filler, filler + "idiot" + filler])
    assert inside > 0.5 > plain


def test_a_letter_in_every_gap_is_tolerated():
    import pandas as pd

    insults = ["idiot", "moron", "stupid", "pathetic", "scum", "loser"]
    toxic = [f"you are a {w} today" for w in insults for _ in range(40)]
    clean = ["the cat sat on the mat", "we went home at night", "a fine day for a walk today"] * 300
    scorer = toxicity.train(pd.DataFrame({"text": toxic + clean, "toxic": [1] * len(toxic) + [0] * len(clean)}))
    for word in insults:
        assert min(scorer.scores([f"we met {c.join(word)} again" for c in "xqz"])) > 0.5, word
    assert scorer.scores(["we met again", "a summit of closed roads"]).max() < 0.5


def test_languages_of_odd_corpora(spark):
    from tempora.llm.words import TRAINING_BYTES

    unlabelled = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.filter_languages(unlabelled, langid.learn(unlabelled)).collect()] == [1]
    rows = [(i, "word " * TRAINING_BYTES if i % 10 else f"short {i}", "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keys = docs.where(langid.fit_to_learn()).select("doc_id", "lang")
    assert len(langid.training_rows(keys, docs, "lang", 15)) == 15
    assert langid.learn(docs, 2).lexicon is not None and len(langid.learn(docs, 2).langs) == 1


def test_code_switched_words_are_labelled_apart(spoken):
    """Words of two languages in one text get their own labels, and the longer part names the text."""
    field = langid.learn(spoken)
    rng = np.random.default_rng(9)
    xx, yy = sentences(rng, ["scha", "lich", "keit"], 14).split(), sentences(rng, ["mente", "cio", "que"], 6).split()
    from tempora.llm.words import Words

    words = Words([" ".join(xx + yy)])
    emitted, _ = field.emissions(words.forms)
    probs = langid.marginals(*langid.forward_backward(emitted[words.at], words.lengths, field.steps, field.first)[:2])
    told = [field.langs[i] for i in probs.argmax(axis=1)]
    assert np.mean([t == "xx" for t in told[:14]]) > 0.9 and np.mean([t == "yy" for t in told[14:]]) > 0.6
    best, score = langid.label(field, [" ".join(xx + yy), " ".join(yy + xx[:2])])
    assert [field.langs[i] for i in best] == ["xx", "yy"] and (score < 1).all()


def test_letters_beyond_the_first_plane(spoken):
    field = langid.learn(spoken)
    none = len(field.langs)
    best, score = langid.label(field, ["\U0001f600\U0001f680 \U0001f4a9", "\U00010400\U00010401", "123 \U0001f600a"])
    assert best[0] == none and score[0] == 0 and best[1] < none and best[2] < none


def test_models_ignore_further_columns_and_keep_repeats(spark, spoken):
    labels = spoken.select("doc_id", "toxic")
    odd = spoken.selectExpr("*", "1 AS score", "2 AS _n", "3 AS held_out", "'x' AS lang_pred").union(spoken.selectExpr("*", "1", "2", "3", "'x'").where("doc_id = 3"))
    assert langid.identify(odd).count() == 241
    scored = toxicity.score_documents(odd, toxicity.learn(odd, labels))
    assert scored.count() == 241 and scored.where("doc_id = 3").select("score").distinct().count() == 1
    long = spark.createDataFrame([(1, "scha " * 60_000 + "blorgo")], "doc_id long, text string")
    assert toxicity.score_documents(long, toxicity.learn(spoken, labels)).first().score > 0.5
