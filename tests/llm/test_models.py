"""Toxicity and quality: exact search against brute force, held-out accuracy on made-up labels, defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from rastrel.llm import common, quality, toxicity

DOCS = "doc_id long, text string, Score int"


def corpus(n=400):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeghiklmnorstu") for _ in range(rng.randint(2, 7)))
    common_words, bad = [word() for _ in range(300)], ["rotgut", "vilest", "scumbag"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common_words) for _ in range(rng.randint(20, 80))]
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        if low:
            words = [w + rng.choice(["###", "%%%", "!!"]) for w in words]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), 1))
        labels.append((i, int(not low), int(toxic)))
    rows += [(5000, None, 1), (5001, "", 1), (None, "lost words", 1), rows[3], (5002, " ".join(common_words) * 60, 1)]
    return rows, labels + [(3, None, 1), (None, 1, 1), (9999, 1, 0)]


def accuracy(rows, labels, column):
    truth = {r[0]: r[column] for r in labels[:400]}
    got = [(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and r["held"]]
    return np.mean(got)


def test_toxicity(spark):
    rows, labels = corpus()
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = common.held_out(F.col("doc_id"), 5, 0)
    got = toxicity.score(docs, table, ~held, toxicity.Shape(examples=150, least=3)).withColumn("held", held).collect()
    assert len(got) == len(rows) and accuracy(got, labels, 2) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["score"] == by[5001]["score"] < 0.2 and by[5000]["nearest"] == []
    known = {i for i, *_ in labels}
    assert all(0 <= r["score"] <= 1 and set(r["nearest"]) <= known and (np.diff(r["similarities"]) < 1e-9).all() for r in got)
    assert toxicity.score(docs.limit(0), table, ~held).count() == 0
    none = toxicity.score(docs, table.where("toxic = 0"), ~held).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.0]
    assert {r[0] for r in toxicity.score(docs, table.limit(0), ~held).select("score").collect()} == {0.5}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    idf = rng.random(40) + 0.5
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 7), replace=False))
        vectors.append((t, toxicity.unit(t, rng.integers(1, 4, len(t)), idf)))
    vectors.sort(key=lambda v: v[0][np.argmax(v[1])])
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index, postings = toxicity.Index.build(vectors, 40, 16), sum(len(t) for t, _ in vectors)
    read = []
    for _ in range(300):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = toxicity.unit(t, rng.integers(1, 4, len(t)), idf)
        index.read = 0
        near, sims = index.nearest(t, w, 9)
        read.append(index.read)
        every = np.round(dense[:, t] @ w, 12)
        want = np.lexsort((np.arange(700), -every))[:9]
        want = want[every[want] > 0]
        assert near.tolist() == want.tolist() and np.allclose(sims, every[want])
    assert np.mean(read) < 0.5 * postings


def test_all_terms_of_the_examples_are_in_the_cosine(spark):
    """Toxic texts known only by a word too rare to be listed, and similarities as brute force has them."""
    rng = random.Random(5)
    shared = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*rng.choices(shared, k=15), *([f"rare{i // 4}x"] * 3 if i < 40 else [f"calm{i // 4}x"] * 3)]), 1) for i in range(200)]
    table = spark.createDataFrame([(i, int(i < 40)) for i in range(200)], "doc_id long, toxic int")
    held = (F.col("doc_id") % 4) == 0
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, DOCS), table, ~held, toxicity.Shape(common=7)).collect()}
    assert all(not r["terms"] for r in got.values())
    assert np.mean([(got[i]["score"] >= 0.5) == (i < 40) for i in range(0, 200, 4)]) > 0.9
    bags = {i: dict(zip(*np.unique(t.split(), return_counts=True))) for i, t, _ in rows}
    space = {w for i in bags if i % 4 for w in bags[i]}
    idf = {w: np.log(201 / (sum(w in b for b in bags.values()) + 1)) + 1 for w in space}
    vector = lambda b: {w: (1 + np.log(c)) * idf[w] / np.sqrt(sum(((1 + np.log(n)) * idf[v]) ** 2 for v, n in b.items() if v in space)) for w, c in b.items() if w in space}
    vectors = {i: vector(b) for i, b in bags.items()}
    for i in (0, 4, 100):
        every = sorted((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) for j in bags if j % 4), reverse=True)
        assert np.allclose(got[i]["similarities"], every[:15])


def test_isotonic_fit():
    x, p = toxicity.isotonic(np.array([0, 0, 1, 2, 3.0]), np.array([0, 1, 0, 1, 1.0]), np.full(5, 100.0))
    assert (np.diff(p) >= 0).all() and np.interp(0, x, p) == np.interp(1, x, p) and np.interp(3, x, p) == 1


def test_quality(spark):
    rows, labels = corpus()
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = common.held_out(F.col("doc_id"), 5, 0)
    shape = quality.Shape(buckets=512, dims=12, hidden=8)
    got = quality.score(docs, table, ~held, shape).withColumn("held", held).collect()
    assert len(got) == len(rows) and accuracy(got, labels, 1) > 0.95
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[5000] == by[5001] and all(0 <= s <= 1 for s in by.values())
    assert quality.score(docs.limit(0), table, ~held, shape).count() == 0
    assert {r["score"] for r in quality.score(docs, table.limit(0), ~held, shape).collect()} == {0.5}


def test_word_vectors_count_neighbours_in_one_text(spark):
    shape = quality.Shape(buckets=64, dims=8)
    one = quality.word_vectors(spark.createDataFrame([("aa bb cc",), ("dd",), (None,)], "text string"), shape)
    two = quality.word_vectors(spark.createDataFrame([("aa bb cc",), ("dd ee",)], "text string"), shape)
    units = quality.units(__import__("pyarrow").array(["dd"]), 64)[0]
    assert not one[units].any() and two[units].any() and np.allclose(one, one)
    places, signs = quality.index_vectors(shape)
    assert places.shape == (64, 2) and set(np.unique(signs)) == {-1.0, 1.0}


def test_temperature_and_network_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(np.int64)  # not linear
    net = quality.train(x, y, 16, epochs=120)
    assert ((net.scores(x.astype(float)) >= 0.5) == y).mean() > 0.93 and net.temperature > 0
