"""Scores of the three models against plain versions of what their modules say, over whole small tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from rastrel.llm import langid, quality, toxicity

from tests.llm.test_langid import corpus as languages


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(70)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 70 if i % 3 else 50]) for _ in range(rng.randint(6, 25)))) for i in range(n)]
    return rows + [(n, ""), (n + 1, None), (n + 2, "unheard words only")]


def test_toxicity_scores(spark):
    rows = made(70, 4)
    labels = {i: int(i % 3 == 0) for i in range(45)}
    shape = toxicity.Shape(evidence=1e9, k=5, common=4, block=4)
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, table, F.lit(True), shape).collect()}
    bags = {i: Counter((t or "").split()) for i, t in rows}
    known = {w for i in labels for w in bags[i]}
    idf = {w: math.log((len(rows) + 1) / (sum(w in b for b in bags.values()) + 1)) + 1 for w in known}

    def vector(bag):
        raw = {w: (1 + math.log(c)) * idf[w] for w, c in bag.items() if w in known}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    vectors = {i: vector(b) for i, b in bags.items()}

    def share(i, without=None):
        sims = [(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in labels if j != without]
        best = sorted((x for x in sims if x[0] > 0), reverse=True)[: shape.k]
        return sum(s * s * labels[j] for s, j in best) / sum(s * s for s, _ in best) if best else 0.0

    x, p = toxicity.isotonic(np.array([share(i, i) for i in labels]), np.array(list(labels.values()), float), np.ones(len(labels)))
    for i, _ in rows:
        assert abs(got[i]["score"] - np.interp(share(i), x, p)) < 1e-9, i
    assert len({round(r["score"], 6) for r in got.values()}) > 3


def test_language_predictions(spark):
    given = languages(5, 40)
    table = spark.createDataFrame(given, "doc_id long, text string, lang string, n int")
    model = langid.train(table.select("text", "lang"), sample=120, dims=256)
    rows = [(i, t) for i, t, *_ in given[::3]] + [(-1, None), (-2, "12"), (-3, "É, là-bas!\tÇa va 12 x")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i, text in rows:
        letters = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (text or "").lower().encode())
        raw = b" " + b" ".join(letters.split()) + b" "
        if not letters.split():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        counts = Counter((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 2654435761 % (1 << 32) >> 24 for k in range(len(raw) - 2))
        margin = {m: sum(n * float(model.weights[b, j]) for b, n in counts.items()) / sum(counts.values()) + model.biases[j] for j, m in enumerate(model.machines)}
        families = sorted(model.families, key=lambda f: -margin["family", f, ""])
        sure = sigmoid(model.slopes[0] * (margin["family", families[0], ""] - margin["family", families[1], ""]))
        (pair,) = [m for m in margin if m[0] == "pair" and langid.family(m[1]) == families[0]]
        want = pair[1] if margin[pair] >= 0 else pair[2]
        assert got[i]["lang_pred"] == want and abs(got[i]["score"] - sure * sigmoid(model.slopes[1] * abs(margin[pair]))) < 1e-5, i


def test_quality_scores(spark):
    rows = [(i, t if i % 4 or not t else t.upper() + " 12!") for i, t in made(60, 8)]
    labels = {i: int(i % 4 == 0) for i in range(40)}
    shape = quality.Shape(buckets=61, dims=6, hidden=4)
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, table, F.lit(True), shape).collect()}
    units = {i: quality.units(pa.array([t or ""]), shape.buckets)[0].tolist() for i, t in rows}
    places, signs = quality.index_vectors(shape)
    sums = np.zeros((shape.buckets, shape.dims))
    for own in units.values():
        for a, b in zip(own, own[1:]):
            for here, there in ((a, b), (b, a)):
                for k in range(quality.NONZERO):
                    sums[here, places[there, k]] += signs[there, k]
    size = np.linalg.norm(sums, axis=1)
    seen = size > 0
    vectors = np.zeros_like(sums)
    vectors[seen] = sums[seen] / size[seen, None]
    vectors[seen] -= vectors[seen].mean(0)
    vectors[seen] /= np.maximum(np.linalg.norm(vectors[seen], axis=1, keepdims=True), 1e-12)

    def features(own):
        if not own:
            return np.zeros(2 * shape.dims + 2)
        each = vectors[own]
        return np.concatenate([each.mean(0), np.sqrt((each * each).mean(0)), [math.log1p(len(own)), len(set(own)) / len(own)]])

    x = {i: features(own) for i, own in units.items()}
    net = quality.train(np.array([x[i] for i in labels], np.float32), np.array(list(labels.values())), shape.hidden)
    want = net.scores(np.array([x[i] for i, _ in rows]))
    assert max(abs(got[i] - w) for (i, _), w in zip(rows, want)) < 2e-3
    assert max(got.values()) - min(got.values()) > 0.2
