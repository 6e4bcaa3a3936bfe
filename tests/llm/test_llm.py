"""Training-data operators against brute force, round trips and held-out labels, and on awkward tables."""

import hashlib
import math
import multiprocessing
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, contamination, embedding_dup, lang_id, mixing, near_dup, pitman_yor, queries, token_store, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, key string, w double"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "ta") for b in ("n", "r", "s") for c in ("a", "e", "o", "um")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "x", 1, "k", 0.5)


def awkward():
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [doc(i, prose(rng, 60), "en" if i % 2 else "de", f"s{i % 3}") for i in range(20)]
    rows += [doc(100 + i, base) for i in range(6)]  # exact copies
    rows += [doc(120 + i, base + f" end{i}") for i in range(4)]  # near copies
    rows += [doc(200, None, None, None), doc(201, ""), doc(202, "   \n\t"), doc(203, "two words"), doc(204, "two words"), doc(205, "Ünïcödé   ﬁ 日本 " * 3)]
    rows += [doc(300, " ".join(WORDS[k % len(WORDS)] + str(k) for k in range(20_000))), doc(100, base), doc(None, "no id at all here", "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def word_list(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = word_list(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_near(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links.append((a, b))
    return sets, closure(ids, links)


def test_near_duplicates_awkward(docs, empty):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs).collect()}
    texts = {r[0]: r[1] for r in awkward() if r[0] is not None}
    sets, roots = brute_near(texts)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["n_shingles"] == len(sets[i]) and r["component_id"] == roots[i] and r["kept"] == (roots[i] == i), i
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i in texts if roots[i] == i)
    assert kept.where("doc_id is null").count() == 1


def test_one_row_an_id_stays(spark):
    rng = random.Random(11)
    a, b = prose(rng, 30), prose(rng, 30)
    rows = [doc(1, a), doc(1, a), doc(2, a), doc(3, a), doc(3, b), doc(4, None), doc(4, None), doc(None, a), doc(None, a)]
    kept = near_dup.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    least = min(a, b)
    want = [(1, a), (4, None), (None, a), (None, a)] + ([(3, b)] if least == b else [])
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == {1: 1, 2: 1, 3: 1 if least == a else 3, 4: 4}


def test_near_duplicates_of_copies_of_one_original(spark):
    """Copies that resemble their original more than each other: a star, whose centre leads no bucket by chance."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(k) for k in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        w = list(base)
        for p in rng.sample(range(200), 5):
            w[p] = f"x{i}y{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, roots = brute_near(dict(rows))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == roots


def test_tensored_keys_meet_when_two_collections_agree():
    a = np.arange(60, dtype=np.uint32)[None, :]
    b = a + 1000
    b[0, 3:6], b[0, 30:33] = a[0, 3:6], a[0, 30:33]
    assert (near_dup.table_keys(a) == near_dup.table_keys(b)).sum() == 1
    assert near_dup.first_key(a[0], b)[0] in near_dup.table_keys(a)[0]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(250)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark)).collect()}
    ids = {x for ab in links for x in ab if ab[0] != ab[1]}
    assert got == {i: r for i, r in closure(ids, [x for x in links if x[0] != x[1]]).items()}


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=16)
    for i in range(300):
        v = base + rng.normal(scale=0.08, size=16) if i % 3 == 0 else rng.normal(size=16)
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(400 + i, rows[0][1], 0) for i in range(4)] + [(450, [2 * x for x in rows[0][1]], 0)]
    bad = [(500, None, 0), (501, [], 0), (502, [0.0] * 16, 0), (503, [float("nan")] * 16, 0), (504, [None] * 16, 0), (505, rows[0][1], None), (506, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows + bad + [rows[1]], "vec_id long, embedding array<float>, label int")
    for size in (8192, 64):
        got = {r["vec_id"]: r for r in embedding_dup.near_duplicates(df, size).collect()}
        x = np.array([r[1] for r in rows], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lab, ids = np.array([r[2] for r in rows]), [r[0] for r in rows]
        near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
        np.fill_diagonal(near, False)
        roots = closure(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
        found = sum(got[i]["n_links"] for i in ids)
        assert found >= 0.99 * near.sum() and all(got[i]["n_links"] <= n for i, n in zip(ids, near.sum(1)))
        assert sum(got[i]["component_id"] == roots[i] for i in ids) >= 0.99 * len(ids)
        assert all(got[b[0]]["n_links"] == 0 and got[b[0]]["kept"] for b in bad)
    assert embedding_dup.near_duplicates(df.limit(0)).count() == 0


def test_graph_search_finds_neighbours():
    rng = np.random.default_rng(0)
    x = embedding_dup.unit(rng.normal(size=(1500, 24)))
    g = embedding_dup.Graph(x)
    q = x[:200].astype(np.float32)
    ids, _ = embedding_dup.beam_search(g.x, g.layers[-1], q, g.entries(q), 64)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), truth.tolist())]) > 0.9


def labelled(spark, n=1500):
    rng = random.Random(9)
    bad = ["idiotka", "morontu", "scumbe"]
    rows, labels = [], []
    for i in range(n):
        t = prose(rng, 40)
        toxic = i % 6 == 0
        if toxic:
            w = t.split()
            w[rng.randrange(40)] = rng.choice(bad)
            t = " ".join(w)
        rows.append(doc(i, t))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, docs, empty):
    d, l = labelled(spark)
    got = toxicity.classify(d, l).join(l, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.drop_toxic(d, l)
    assert kept.columns == d.columns and abs(kept.count() - 1250) < 15
    none = l.limit(0)
    assert all(0 < r["score"] < 1 for r in toxicity.classify(docs, none).collect())
    one = spark.createDataFrame([(i, 0) for i in range(5)] + [(6, None)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.classify(docs, one).collect()} == {0}
    assert toxicity.classify(empty, l).count() == 0 and toxicity.classify(docs, one).count() == docs.count()


def test_contamination(spark, docs, empty):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 5, 9, 20, 33, 64, 130))] + [(90, None), (91, ""), (0, "x y")]
    rows = []
    for i in range(60):
        w = prose(rng, 300 + 40 * i).split()
        if i % 2:
            t = items[i % 7][1].split()
            if i % 4 == 1 and len(t) > 30:
                t[len(t) // 2] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = t
        rows.append(doc(i, " ".join(w)))
    rows.append(doc(70, items[0][1]))
    d = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(r[0], i) for r in rows for i, t in items if shingles(t) and 100 * len(shingles(r[1]) & shingles(t)) >= 75 * len(shingles(t))}
    got = contamination.contaminated(d, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 20
    assert contamination.drop_contaminated(d, bench).count() == len(rows) - len({a for a, _ in want})
    old, contamination.ITEM_SHINGLES = contamination.ITEM_SHINGLES, 40  # several blocks of items
    try:
        assert {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(d, bench).collect()} == want
    finally:
        contamination.ITEM_SHINGLES = old
    assert contamination.contaminated(docs, bench.limit(0)).count() == 0 and contamination.contaminated(empty, bench).count() == 0


def test_contamination_of_very_short_items_and_very_long_texts(spark):
    rng = random.Random(17)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (5, 6, 7, 8, 9, 12, 13)] * 2
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(60_000)).split()
    rows = []
    for k, (n, t) in enumerate(items[:7] * 12):
        at = rng.randrange(len(long) - 3000)
        rows.append((k, " ".join([*long[at : at + rng.randrange(20, 2000)], t, *long[at + 2000 : at + 2500]])))
    rows.append((1000, " ".join([*long, *(t for _, t in items), *long])))
    got = contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, items[k % 7][0]) for k in range(len(rows) - 1)} | {(1000, n) for n, _ in items}


def test_language(spark, docs, empty):
    rng = random.Random(6)
    vocab = {"aa": ["the", "and", "house", "river"], "bb": ["und", "haus", "fluss", "oder"]}
    rows = [doc(i, " ".join(rng.choice(vocab[l]) for _ in range(rng.randint(3, 30))), l) for i in range(200) for l in [("aa", "bb")[i % 2]]]
    rows += [doc(300, None, "aa"), doc(301, "123 ...", "aa"), doc(302, "the " * 5, None), doc(303, "x" * 5000, "aa")]
    got = {r["doc_id"]: r for r in lang_id.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in rows[:200]]) > 0.99
    assert got[300]["lang_pred"] == got[301]["lang_pred"] == "und" and got[302]["lang_pred"] == "aa"
    assert lang_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_algorithm_sums_all_segmentations():
    v = lang_id.vocabulary(lang_id.VOCABULARY)
    rng = np.random.default_rng(0)
    p = rng.random((v.size + 1, 2)) / v.size
    word = "there"
    s = lang_id.MARK + word

    def brute(at):
        if at == len(s):
            return np.ones(2)
        total = np.zeros(2)
        for e in range(at + 1, len(s) + 1):
            h = np.array([0], np.uint64)
            for c in s[at:e]:
                h = v.extend(h, np.array([ord(c)], np.uint64))
            i = v.find(h)[0]
            if i >= 0 or e == at + 1:
                total = total + p[i if i >= 0 else v.size] * brute(e)
        return total

    assert np.allclose(lang_id.word_log_probs([word], v, p)[0], np.log(brute(0)))


def test_language_of_signs_and_long_words(spark):
    v = lang_id.vocabulary(lang_id.VOCABULARY)
    assert lang_id.words("½ ² ① 12 _") == [] and lang_id.words("aB½c, Ö1") == ["ab", "c", "ö"]
    rng = np.random.default_rng(3)
    p = rng.random((v.size + 1, 3)) / v.size
    word = "there" * 6 + "bü"
    assert len(word) <= lang_id.BATCHED
    short = lang_id.word_log_probs([word], v, p)[0]
    ids = v.pieces_of(word)
    assert np.allclose(short, lang_id._long_forward(ids, np.vstack([p, np.zeros(3)])))
    # Expected uses of pieces: every letter is in one piece of each segmentation.
    x = lang_id._long_expected(ids, np.append(p[:, 1], 0))
    assert abs((x * np.arange(1, len(x) + 1)[:, None]).sum() - len(word) - 1) < 1e-6
    huge = "a" * 3000
    got = lang_id.word_log_probs([huge, "a"], v, p)
    assert np.isfinite(got).all() and (got[0] < got[1]).all()
    rows = [doc(i, "the house and the river " * 4, "aa") for i in range(30)] + [doc(i, "und das haus oder der fluss " * 4, "bb") for i in range(30, 60)]
    rows += [doc(70, "½ ² ①", "aa"), doc(71, "haus" * 200, None), doc(72, ("the house " * 3000) + "z" * 500, None), doc(3, "fluss", "bb"), doc(None, "the river", "cc")]
    got = [(r["doc_id"], r["lang_pred"], r["held_out"]) for r in lang_id.identify(spark.createDataFrame(rows, DOCS)).collect()]
    by = {i: l for i, l, _ in got}
    assert len(got) == len(rows) and (by[70], by[72]) == ("und", "aa") and by[None] in ("aa", "bb") and [h for i, _, h in got if i is None] == [None]


def test_toxicity_scores_are_those_of_the_plain_model(spark):
    """n-grams, counts, ratios and scores by dictionaries over strings; only the fitted weights are taken."""
    d, l = labelled(spark, 300)
    model = toxicity.fit(d, l.select("doc_id", F.col("toxic").alias("label")))
    texts, y = {r["doc_id"]: r["text"] for r in d.collect()}, {r["doc_id"]: r["toxic"] for r in l.collect()}

    def runs_of(t):
        t = " " + " ".join(t.lower().split()) + " "
        return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)}

    pos, neg = Counter(), Counter()
    for i, t in texts.items():
        (pos if y[i] else neg).update(runs_of(t))
    n1, n0 = sum(y.values()), len(y) - sum(y.values())
    want = {}
    for g in set(pos) | set(neg):
        p, q = (pos[g] + 1) / (n1 + 2), (neg[g] + 1) / (n0 + 2)
        if abs(p - q) / np.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0) >= toxicity.APART or pos[g] >= toxicity.ALONE and not neg[g]:
            want[g] = np.log(p / q)
    assert len(model.kept) == len(want) and np.allclose(sorted(model.ratio), sorted(want.values()))
    for t in [*list(texts.values())[:40], None, "", "  Ünïcödé 日本 ", "x" * 100_000]:
        has = runs_of(t or "")
        assert len(model.features(t)) == sum(g in want for g in has)
        assert abs(model.score(t) - 1 / (1 + np.exp(-(model.bias + model.weight[model.features(t)].sum())))) < 1e-12


def test_toxicity_keeps_varied_wording(spark):
    # 2,500 toxic words, each in a tenth of the toxic texts: every one has n-grams of its own among the features.
    rng = random.Random(12)
    toxic = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(2500)]
    rows = [doc(i, " ".join(rng.sample(toxic, 250)) if i % 2 else prose(rng, 250)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), labels)
    assert len(model.kept) > 15_000
    assert all(len(model.features(w)) for w in toxic)


def test_toxicity_fit_leaves_the_rows_on_the_executors(spark):
    rng = random.Random(13)
    toxic = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(400)]
    texts = [" ".join(rng.sample(toxic, 250)) if i % 2 else prose(rng, 250) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, label int")
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS).cache()
    docs.count()
    tracemalloc.start()
    model = toxicity.fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    features = sum(len(model.features(t)) for t in texts)
    assert features > 1_000_000 and most < 4 * features  # all features of the sample are 4 bytes each, before what a fit on the driver makes of them


def test_token_store_leaves_the_tokenizer_to_the_executors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "_tokenizer", lambda name: pytest.fail("the driver reads the tokenizer"))
    token_store.write_store(spark.createDataFrame([doc(1, "a text"), doc(2, None)], DOCS), f"file://{tmp_path}/store")
    assert {r["width"] for r in spark.read.parquet(f"file://{tmp_path}/store/chunks").collect()} == {2}


def test_table_of_ngrams_loses_none():
    kept = np.arange(1, 60_001, dtype=np.int64) << 3  # all in a few slots at first
    m = toxicity.Model(kept, np.ones(len(kept)))
    m._index()
    assert len(np.unique(m._table[m._table >= 0])) == len(kept)
    text = "some words of a text"
    g = np.unique(toxicity.grams(text))
    m = toxicity.Model(np.sort(np.concatenate([kept, g])), np.ones(len(kept) + len(g)))
    assert len(m.features(text)) == len(g)


def test_pitman_yor(spark, docs, empty):
    rng = random.Random(8)
    rows = [doc(i, prose(rng, 50)) for i in range(120)] + [doc(500, None), doc(501, "  "), doc(502, "entirely unseen wordings"), doc(3, "again the same id")]
    d = spark.createDataFrame(rows, DOCS)
    got = pitman_yor.score(d).collect()
    assert len(got) == len(rows)
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    c = Counter(w for r in rows if not held[r[0]] for w in [*word_list(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = [*word_list(r[1]), None]
        want[(r[0], held[r[0]], len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert pitman_yor.score(empty).count() == 0 and pitman_yor.score(docs).count() == docs.count()
    null = pitman_yor.score(docs).where("doc_id is null").collect()
    assert [r["held_out"] for r in null] == [None]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pitman_yor.score(d).collect()), key=str)
    untaught = pitman_yor.score(spark.createDataFrame([doc(None, "no fold at all")], DOCS)).first()
    assert untaught["train_tokens"] == 0 and abs(untaught["score"]) < 1e-6


def naive_scores(rows, sweeps=pitman_yor.SWEEPS):
    """The model by dictionaries over pairs of words: no blocks, parts or owners, one draw after another."""
    tok = lambda t: [*word_list(t), None]
    train = [tok(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    ident = lambda w: pitman_yor.END if w is None else common.word_hashes([w]).view(np.int64)[0]
    c, cu, cw = Counter(), Counter(), Counter()
    for w in train:
        for u, x in zip([None, *w[:-1]], w):
            c[u, x] += 1
            cu[u] += 1
            cw[x] += 1
    n, v = sum(cw.values()), len(cw)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = float(np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1, 0.9))
    dish = Counter(w for _, w in c)  # tables of one customer each at first
    many = np.zeros(len(pitman_yor.DISCOUNTS))
    for w, k in dish.items():
        many += k * np.log(k - 1 - pitman_yor.DISCOUNTS) if k > 1 else np.log(1 + pitman_yor.DISCOUNTS * (v - 1))
    d0 = float(pitman_yor.DISCOUNTS[many.argmax()])
    base, t, t0 = 1 / (v + 1), {p: 1 for p in c}, {w: 1 for w in cw}
    draw = lambda key, s: pitman_yor.uniform(np.array([key], np.uint64), s)
    keys = {p: pitman_yor.pair_key(np.array([ident(p[0])]), np.array([ident(p[1])]))[0] for p in c}
    root_keys = {w: pitman_yor._mixed(np.array([ident(w)]).view(np.uint64))[0] for w in cw}
    one = lambda count, p, others, disc, strength, u: int(pitman_yor.tables(np.array([count]), np.array([p]), np.array([others]), disc, strength, u)[0])

    def totals():
        by_u, by_w = Counter(), Counter()
        for (u, w), k in t.items():
            by_u[u] += k
            by_w[w] += k
        return by_u, by_w

    def unigram(by_w):
        s, top = sum(by_w.values()), sum(t0.values())
        back = (1 + d0 * top) / (1 + s) * base
        return {w: (by_w[w] - d0 * t0[w]) / (1 + s) for w in cw}, back

    by_u, by_w = totals()
    own, back = unigram(by_w)
    like = [sum(k * np.log((k - 1 - d * min(1, k - 1) + (s + d * (by_u[u] - (1 - min(1, k - 1)))) * (own[w] + back)) / (s + cu[u] - 1)) for (u, w), k in c.items()) for s in pitman_yor.STRENGTHS]
    strength = float(pitman_yor.STRENGTHS[int(np.argmax(like))])
    kept = []
    for s in range(1, sweeps + 1):
        new = {p: 1 if k == 1 else one(k, own[p[1]] + back, by_u[p[0]] - t[p], d, strength, draw(keys[p], s)) for p, k in c.items()}
        t = new
        by_u, by_w = totals()
        top = sum(t0.values())
        t0 = {w: one(by_w[w], base, top - t0[w], d0, 1.0, draw(root_keys[w], s)) for w in cw}
        own, back = unigram(by_w)
        if s > pitman_yor.BURN_IN:
            kept.append((dict(t), by_u, own, back))
    mean = lambda f: sum(map(f, kept)) / len(kept)
    pair_t = {p: mean(lambda k: k[0][p]) for p in c}
    tables_of, first = {u: mean(lambda k: k[1][u]) for u in cu}, {w: mean(lambda k: k[2][w]) for w in cw}
    behind = mean(lambda k: k[3])
    out = []
    for i, text in rows:
        w = tok(text)
        p = [((c[u, x] - d * pair_t.get((u, x), 0)) + (strength + d * tables_of.get(u, 0)) * (first.get(x, 0) + behind)) / (strength + cu[u]) for u, x in zip([None, *w[:-1]], w)]
        out.append((i, sum(np.log10(p))))
    return out


def test_pitman_yor_scores_are_those_of_the_naive_model(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(WORDS[: 4 + i % 20]) for _ in range(rng.randint(0, 60)))) for i in range(90)] + [(200, "ba ba ba"), (207, "never seen before"), (208, "")]
    want = dict(naive_scores(rows))
    d = spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)
    for block, part in ((10_000_000, 48_000_000), (2_000, 4_000)):
        monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", block)
        monkeypatch.setattr(pitman_yor, "PART_BYTES", part)
        got = {r["doc_id"]: r for r in pitman_yor.score(d).collect()}
        assert all(abs(got[i]["score"] - s) < 1e-4 * max(1, abs(s)) for i, s in want.items())
    test = [r for r in got.values() if r["held_out"]]
    assert len(test) > 5 and sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_unseen_words_are_no_likelier_than_seen_ones(spark):
    rng = random.Random(5)
    ids = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [doc(i, prose(rng, 60)) for i in range(200)] + [doc(ids[0], prose(rng, 30)), doc(ids[1], " ".join(f"qq{k}" for k in range(30)))]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(rows, DOCS)).where("doc_id >= 1000").collect()}
    assert got[ids[0]] > got[ids[1]] + 10


def test_pitman_yor_context_is_the_whole_word(spark):
    # Long words that end alike, each with its own follower: only the whole word tells what comes next.
    rng = random.Random(4)
    follows = {f"{k}context": f"follower{k}" for k in ("alpha", "beta", "gamma", "delta", "kappa", "omega", "sigma", "theta")}
    rows = [doc(i, " ".join(f"{k} {follows[k]}" for k in rng.choices(list(follows), k=20))) for i in range(200)]
    ids = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    right = " ".join(f"{a} {b}" for a, b in follows.items())
    wrong = " ".join(f"{a} {b}" for a, b in zip(follows, [*list(follows.values())[1:], list(follows.values())[0]]))
    d = spark.createDataFrame([*rows, doc(ids[0], right), doc(ids[1], wrong)], DOCS)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(d).where(F.col("doc_id") >= 1000).collect()}
    assert got[ids[0]] > got[ids[1]] + 8


def test_pitman_yor_in_several_blocks(spark, monkeypatch):
    rng = random.Random(6)
    d = spark.createDataFrame([doc(i, prose(rng, 40) + f" rare{i % 50} once{i}") for i in range(150)], DOCS)
    one = {r["doc_id"]: r for r in pitman_yor.score(d).collect()}
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 8_000)
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 20_000)
    for r in pitman_yor.score(d).collect():
        was = one[r["doc_id"]]
        assert r[1:5] == was[1:5] and abs(r["base_score"] - was["base_score"]) < 1e-9 and abs(r["score"] - was["score"]) < 1e-6 * abs(was["score"])


def test_table_counts_follow_the_restaurant():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 5, 40, 48, 49, 60, 500, 5000] * 400)
    t = pitman_yor.tables(c, np.full(len(c), 0.01), np.full(len(c), 50), 0.5, 1.0, rng.random(len(c)))
    assert (t[c == 0] == 0).all() and (t[c == 1] == 1).all() and (t <= np.maximum(c, 0)).all() and (t[c > 0] >= 1).all()
    means = [t[c == k].mean() for k in (2, 5, 40, 48, 49, 60, 500, 5000)]
    assert all(a <= b + 0.2 for a, b in zip(means, means[1:])) and abs(means[3] - means[4]) < 0.4


@pytest.mark.parametrize("d", [0.1, 0.5, 0.76, 0.9])
def test_large_stirling_numbers(d):
    """The saddle point against the exact recursion, at 200 customers: relative to 20 tables, and in what is drawn."""
    exact, most = np.full(201, -np.inf), 200
    exact[1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            exact[t] = np.logaddexp(exact[t - 1], np.log(np.maximum(c - d * t, 1e-300)) + exact[t])
    t = np.arange(1, 199)
    near = pitman_yor.log_stirling_large(np.full(len(t), 200.0), t.astype(float), d)
    gap = np.abs(near - exact[t] + math.lgamma(201))
    assert gap.max() < 0.35 and gap[4:].max() < 0.2
    for parent, others in ((1e-4, 10), (0.01, 300), (0.2, 3000)):
        t = np.arange(1, 200)
        logs = exact[t] + np.cumsum(np.log(1.0 + d * (others + t - 1)) + np.log(parent))
        p = np.exp(logs - logs.max())
        p /= p.sum()
        mean, sd = (p * t).sum(), np.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
        draws = (np.arange(2000) + 0.5) / 2000
        got = pitman_yor.tables(np.full(2000, 200), np.full(2000, parent), np.full(2000, others), d, 1.0, draws)
        assert abs(got.mean() - mean) < 0.1 * sd + 0.1 and abs(got.std() - sd) < 0.1 * sd + 0.2


def test_mixing(spark, docs, empty):
    rng = random.Random(2)
    rows = [doc(i, prose(rng, rng.randint(1, 40)), source=["a", "b", "c", None, "é"][min(i % 7, 4)]) for i in range(900)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.assign(d).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(word_list(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(word_list(rows[r["doc_id"]][1])) and r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in size)
    order = mixing.training_order(d)
    assert order.columns == d.columns and order.count() == sum(r["copies"] for r in got)
    again = {(r["doc_id"], r["taken"]) for r in mixing.assign(d.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.assign(empty).count() == 0 and mixing.training_order(empty).count() == 0
    assert mixing.assign(docs).count() == docs.count()


def test_mixing_plan_is_native(spark, docs):
    plan = mixing.assign(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_token_store(spark, docs, empty, tmp_path):
    tok = token_store.encoder(token_store.TOKENIZER).tok
    path = "file://" + str(tmp_path / "store")
    token_store.write_store(docs, path)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    assert len(got) == docs.count() and all(r["verified"] for r in got) and token_store.verify_manifest(spark, path)
    texts = defaultdict(Counter)
    for r in awkward():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        texts[r[0]][(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    start, last = 0, -1
    for r in got:
        assert r["start"] == start and texts[r["doc_id"]][(r["n_tokens"], r["ids_crc32"])] > 0
        assert last <= (r["doc_id"] if r["doc_id"] is not None else -1)
        start, last = start + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else -1
    whole = {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in token_store.reconstruct(spark, path).collect()}
    assert whole == {(r["start"], r["ids_crc32"]) for r in got}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert token_store.tokenize(empty).count() == 0


def test_encoder_is_exact():
    enc = token_store.encoder(token_store.TOKENIZER)
    rng = random.Random(1)
    parts = ["a", "b ", " ", "\n", ".", ",", " the", "é", "1", "\t", "'s", "ab.\n", "<|endoftext|>", "X, ", "日", "\r\n", "\x1c", " ", " Zu.\nMa"]
    texts = ["".join(rng.choice(parts[: rng.choice((6, 12, len(parts)))]) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", "w" * 3000]
    for k in range(0, len(texts), 700):
        ids, ends = enc.encode(pa.array(texts[k : k + 700], pa.string()))
        for t, s, e in zip(texts[k : k + 700], [0, *ends], ends):
            assert ids[s:e].tolist() == tok_ids(enc, t), repr(t)
    assert enc.encode(pa.array([], pa.string()))[0].tolist() == []


def test_pieces_are_those_of_the_pre_tokenizer():
    enc = token_store.encoder(token_store.TOKENIZER)
    rng = random.Random(2)
    parts = ["a", " ", "\n", ".", "'", "'re", "'S", "7", "é", "×", "÷", "ɏ", "ɐ", "я", "e\u0301", "²", "½", "’", "\u00a0", "\u3000", "\u2028", "\u0085", "𝒳", "😀", "\x00", "\x7f", "[", "~", "_", "ª", "Ω", "日", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    limit, enc.LIMIT = enc.LIMIT, 500
    try:
        for k in range(0, len(texts), 500):
            ids, ends = enc.encode(pa.array(["before", *texts[k : k + 500]], pa.string()).slice(1))
            assert len(enc.known) <= 4000 and max(map(len, enc.known.to_pylist())) <= enc.LONGEST
            for t, s, e in zip(texts[k : k + 500], [0, *ends], ends):
                assert ids[s:e].tolist() == tok_ids(enc, t), repr(t)
    finally:
        enc.LIMIT = limit
    cut, ends = token_store.pieces(pa.array(["It's so, 'x' a1.\nBé \n", "", "c"]))
    assert cut.to_pylist() == ["It", "'s", " so", ",", " 'x", "'", " a", "1", ".", "\n", "Bé", " \n", "", "", "c", ""] and ends.tolist() == [12, 13, 15]


def syllables(rng, n):
    """Texts in which most words are new, as in the check tool's documents."""
    parts = ["th", "on", "er", "in", "an", "tion", "re", "ed", "nd", "ha", "en", "wh", "ou", "sh", "st", "ing", "or", "ea", "ti", "ble"]
    some = [a + b + c for a in parts for b in parts for c in parts]
    words = [some[i] + some[j] for i, j in rng.integers(0, len(some), (n * 500, 2)).tolist()]
    return [" ".join(words[k : k + 500]) for k in range(0, n * 500, 500)]


def _memory():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024


def _grown(out):
    enc = token_store.Encoder(token_store.TOKENIZER)
    rng = np.random.default_rng(5)
    texts, before = [pa.array(syllables(rng, 700)) for _ in range(3)], _memory()
    for t in texts:
        enc.encode(t)
    out.put(_memory() - before)


def test_encoder_stays_small():
    """What an encoder keeps and works with, in a process of its own: MB after three batches of new words."""
    ctx = multiprocessing.get_context("spawn")
    out = ctx.Queue()
    p = ctx.Process(target=_grown, args=(out,))
    p.start()
    grown = out.get(timeout=300)
    p.join()
    assert grown < 110


def test_texts_go_to_the_encoder_in_batches_by_size(spark, tmp_path, monkeypatch):
    """No batch holds much more text than is encoded at once, however few rows that is."""
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("ab " * 4000).alias("text"))

    def seen(name):
        def run(batches):
            for b in batches:
                assert b.nbytes < 2 * token_store.PORTION, b.nbytes
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([1] * n, pa.int64()), pa.array([b"n"] * n, pa.binary()), pa.array([[b"k"]] * n, pa.list_(pa.binary())), pa.array([[b"d"]] * n, pa.list_(pa.binary()))], ["row", "doc_id", "place", "n_tokens", "node", "keys", "data"])

        return run

    monkeypatch.setattr(token_store, "_chunked", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    token_store.write_store(rows, "file://" + str(tmp_path / "store"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def tok_ids(enc, t):
    return enc.tok.encode(t or "", add_special_tokens=False).ids + [token_store.END_ID]


def test_crc_of_parts():
    x = np.random.default_rng(0).integers(0, 2**31, 5000).astype("<u4")
    cut = [0, 3, 700, 701, 4999, 5000]
    parts = np.array([zlib.crc32(x[i:j].tobytes()) for i, j in zip(cut, cut[1:])])
    assert np.bitwise_xor.reduce(token_store.carried(parts, 5000 - np.array(cut[1:]))) == zlib.crc32(x.tobytes())


def test_equal_passages_share_chunks():
    ids = np.random.default_rng(1).integers(0, 50_000, 9000).astype("<u2")
    moved = np.concatenate([ids[:37][::-1], ids])
    ends = lambda x: token_store.cuts(x, np.array([len(x)]))[0]
    cut = lambda x: {x[s:e].tobytes() for s, e in zip([0, *ends(x)], ends(x))}
    both = token_store.cuts(np.concatenate([moved, ids]), np.array([9037, 18037]))
    assert both[1] == [c + 9037 for c in token_store.cuts(ids, np.array([9000]))[0]]
    assert len(cut(ids) & cut(moved)) >= len(cut(ids)) - 2


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_urls(spark):
    urls = ["http://A.Example.com/en/70?x", "https://b.com/en/1#t", "http://com/en/", "http://xcom/en/", "ftp://a.example.net/de/81/x", "no scheme", None, "", "://", "http://h.org/es", "http://h.org/es/://x", "http://Ä.org?/es/", "http://u:p@h.net:80/de/"]
    urls += [f"http://bad.io/junk/{i}" for i in range(80)] + [f"http://bad.io/good/{i}" for i in range(80)]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, int("/junk/" in (u or ""))) for i, u in enumerate(urls)] + [(5, None)], "page_id long, bad int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        u, host, path = urls[r["page_id"]], "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fit)[1] if fit else None), u
        if fit:
            assert r["verdict"] == max(fit)[2]
        elif host == "bad.io":
            assert r["verdict"] == ("block" if "/junk/" in u else "allow")
    assert url_filter.judge(pages.limit(0), rules, labels).count() == 0


def test_chats(spark):
    says = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", says), (1, 1, "assistant", says), (2, 0, "system", None), (2, 1, "user", "a<next>b\\l"), (2, 2, "user", ""), (2, 3, "assistant", "x"), (2, 4, "assistant", "日本\n</turn>\n"), (2, 5, None, "n"), (3, 1, "assistant", "later"), (3, 0, "assistant", "first"), (3, 1, "assistant", "later"), (None, 0, "<turn>", "\\b\\h#"), (4, None, "user", "t")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, n int")
    got = {r["conv_id"]: r for r in chat.digest(chat.written_chats(d)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    plan = chat.format_chats(d)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.digest(chat.written_chats(d.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


AWKWARD_CHATS = [(1, 0, "assistant", "x" * 300_000), *((2, k, ("user", "assistant")[k % 3 > 0], f"t{k}<") for k in range(2_000))]


def test_long_conversations(spark):
    d = spark.createDataFrame(AWKWARD_CHATS, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.written_chats(d)).collect()}
    for c in (1, 2):
        loss = "".join(x for i, _, r, x in AWKWARD_CHATS if i == c and r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_embedding_labels_of_any_type_and_large_numbers(spark):
    rows = [(1, [1e200, 1e200], "a"), (2, [2e200, 2e200], "a"), (3, [1e-300, 1e-300], "a"), (4, [1.0, -1.0], "a"), (5, [1.0, 1.0], "b"), (6, [1.0, 1.0], None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_pipeline_stages_on_awkward_and_empty_tables(spark, docs, empty, tmp_path):
    import corpus_pipeline

    at = "file://" + str(tmp_path)
    spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "ba bo"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    scratch = common.Scratch(spark)
    for table in (docs, empty):
        x = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, x = x, scratch.put(stage(spark, x, at), name)
            assert k == 4 or x.columns == before.columns
            ids = [r[0] for r in x.select("doc_id").collect()]
            assert name != "near_dedup" or len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
        assert (x.count() > 0) == (table is docs)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, scratch = docs.columns, common.Scratch(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.put(stage(spark, docs, sf), name)
        assert k == 4 or docs.columns == cols
    assert docs.count() > 0 and docs.where("not verified").count() == 0


def test_blocks_of_a_bucket_meet_wherever_components_differ(spark):
    rows = [(1, i, 0) for i in range(400)] + [(1, 1000 + i, 1000 + i // 3) for i in range(30)] + [(1, 2000 + i, 2000) for i in range(90)] + [(2, i, i % 3) for i in range(25)] + [(3, 5, 5), (3, 6, 6)]
    dealt = near_dup._blocks(spark.createDataFrame(rows, "key long, rep long, comp long"), 40).collect()
    groups = defaultdict(lambda: (set(), set()))
    for r in dealt:
        groups[r["key"], min(r["block"], r["other"]), max(r["block"], r["other"])][r["block"] > r["other"]].add((r["rep"], r["comp"]))
    met = set()
    for (key, i, j), (a, b) in groups.items():
        met |= {(key, min(x, y), max(x, y)) for x, c in a for y, d in (a if i == j else b) if c != d}
    assert met == {(k, x, y) for k, x, c in rows for m, y, d in rows if k == m and x < y and c != d}
    # 400 members of one component go to the blocks of the other 120, not to each other's.
    sent = Counter((r["key"], r["comp"]) for r in dealt)
    assert sent[1, 0] == 400 * (1 + 3) and sent[1, 2000] == 90 * (1 + 10)


def test_rows_without_an_id_share_no_bucket_of_the_mix(spark):
    d = spark.createDataFrame([(None, f"w{i} x y", "a") for i in range(60_000)], "doc_id long, text string, source string")
    got = mixing.assign(d).select("taken", "positions")
    assert got.count() == 60_000 and abs(got.agg({"taken": "sum"}).first()[0] - 1.5 * 180_000) <= 6
    firsts = [r["positions"][0] for r in got.collect() if r["positions"]]
    assert len(set(firsts)) == len(firsts)


def test_the_store_keeps_the_training_order(spark):
    import corpus_pipeline

    rng = random.Random(8)
    d = spark.createDataFrame([doc(i, prose(rng, 12), source="ab"[i % 2]) for i in range(400)], DOCS)
    ordered = mixing.training_order(d)
    want = [r["doc_id"] for r in ordered.collect()]
    scratch = common.Scratch(spark)
    written = scratch.put(ordered, "mixed")
    assert want != sorted(want)
    assert [r["doc_id"] for r in corpus_pipeline.token_stage(spark, written, "").orderBy("start").collect()] == want
    assert [r["doc_id"] for r in corpus_pipeline.token_stage(spark, d.repartition(5), "").orderBy("start").collect()] == list(range(400))
