"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature.

A word gives its lower-case form, the signs at its ends if any, and its shape if it is in capitals or has digits; each of
these units is hashed to one of `buckets`. Random indexing: a unit has a fixed index vector with `NONZERO` entries of 1
or -1 among `dims`, and its word vector is the sum of the index vectors next to it over the whole corpus, centred and
scaled to length 1. A document's features are the mean and the root mean square of its units' vectors, and two measures
of its length. The network (one hidden layer of tanh) learns from at most `sample` labelled rows, chosen by a hash of
doc_id; a fifth of them sets the temperature by which its logit is divided.

Two passes read whole texts: one for word vectors, whose sums are partial aggregates of a row a bucket, one for features.
The driver holds buckets x dims sums and sample x (2 dims + 2) features.

Defined cases: a null or empty text has zero features and gets the score the network gives those; a doc_id with several
labels takes the largest; null labels and null doc_ids teach nothing; without labels of both kinds every score is the
share of 1 among those there are, or 0.5; repeated rows get the same score, and a doc_id with several texts teaches one of
them; equal features have equal scores; texts of any length are read whole; other columns, whatever their names, are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, common

NONZERO = 2


@dataclass(frozen=True)
class Shape:
    buckets: int = 8192
    dims: int = 32
    hidden: int = 24
    sample: int = 20_000


def _units(distinct: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(units of all words one after the other, how many each has)."""
    import xxhash

    forms = batches.strings(batches.terms(distinct))
    out, sizes = [], np.empty(len(distinct), np.int64)
    name = lambda kind, x: xxhash.xxh32_intdigest(kind + x) % buckets
    for i, (word, form) in enumerate(zip(batches.strings(distinct), forms)):
        n = len(out)
        if form:
            out.append(name("w", form))
            if len(form) > 1 and word.upper() == word and word.lower() != word:
                out.append(name("s", "capitals"))
            if any("0" <= c <= "9" for c in form):
                out.append(name("s", "digits"))
        if len(form) < len(word):
            at = word.lower().find(form) if form else 0
            out.append(name("m", (word[:at] + " " + word[at + len(form) :])[:8]))
        sizes[i] = len(out) - n
    return np.array(out, np.int64), sizes


def units(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(units of all texts, where each text's units begin and end)."""
    distinct, index, starts = batches.words(column)
    known, sizes = _units(distinct, buckets)
    first, each = np.cumsum(sizes) - sizes, sizes[index]
    ends = np.concatenate([[0], np.cumsum(each)])
    flat = known[np.arange(ends[-1]) + np.repeat(first[index] - ends[:-1], each)] if len(index) else np.zeros(0, np.int64)
    return flat, ends[starts]


def index_vectors(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, the places and the signs of its index vector."""
    rng = np.random.Generator(np.random.PCG64(11))
    places = np.argsort(rng.random((shape.buckets, shape.dims)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (shape.buckets, NONZERO))


def word_vectors(docs: DataFrame, shape: Shape = Shape()) -> np.ndarray:
    """A vector of length 1, or 0 for unseen, for each bucket, from all texts."""

    def run(given):
        places, signs = index_vectors(shape)
        sums = np.zeros(shape.buckets * shape.dims)
        for batch in batches.slices(given, "text"):
            flat, edges = units(batch.column("text"), shape.buckets)
            inside = np.ones(max(0, len(flat) - 1), bool)  # neighbours in one text
            cuts = edges[1:-1]
            inside[cuts[(cuts > 0) & (cuts < len(flat))] - 1] = False
            left, right = flat[:-1][inside], flat[1:][inside]
            for a, b in ((left, right), (right, left)):
                for k in range(NONZERO):
                    sums += np.bincount(a * shape.dims + places[b, k], signs[b, k], minlength=len(sums))
        table = sums.reshape(shape.buckets, shape.dims)
        some = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, i]) for i in range(shape.dims))], ["bucket", *(f"v{i}" for i in range(shape.dims))])

    schema = "bucket long, " + ", ".join(f"v{i} double" for i in range(shape.dims))
    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    rows = seen.groupBy("bucket").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(shape.dims))).collect()
    table = np.zeros((shape.buckets, shape.dims))
    for r in rows:
        table[r[0]] = r[1:]
    size = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, size, out=np.zeros_like(table), where=size > 0)
    some = size[:, 0] > 0
    if some.any():
        table[some] -= table[some].mean(0)
        table[some] /= np.maximum(np.linalg.norm(table[some], axis=1, keepdims=True), 1e-12)
    return table.astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, x: little-endian float32 features of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(given):
        own = shared.value
        buckets, dims = own.shape
        for batch in batches.slices(given, "text"):
            flat, edges = units(batch.column("text"), buckets)
            out = np.zeros((batch.num_rows, 2 * dims + 2), np.float32)
            for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                if a < b:
                    held, times = np.unique(flat[a:b], return_counts=True)
                    rows, share = own[held], (times / (b - a)).astype(np.float32)
                    out[i, :dims] = share @ rows
                    out[i, dims : 2 * dims] = np.sqrt(share @ (rows * rows))
                    out[i, 2 * dims] = np.log1p(b - a)
                    out[i, 2 * dims + 1] = len(held) / (b - a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in out], pa.binary())], ["doc_id", "x"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut.mapInArrow(run, "doc_id long, x binary")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) * self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on mini-batches of logistic loss with weight decay; a fifth of the rows sets the temperature."""
    if not len(y) or len(set(y.tolist())) < 2:
        return Network(*[np.zeros(0)] * 5, 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.Generator(np.random.PCG64(seed))
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    fx, fy = x[~held].astype(np.float64), y[~held].astype(np.float64)
    net = Network(fx.mean(0), 1 / (fx.std(0) + 1e-3), rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0, 1.0)
    fx = (fx - net.mean) * net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(fy))
        for at in range(0, len(fy), 128):
            i = order[at : at + 128]
            h = np.tanh(fx[i] @ params[0] + params[1])
            err = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - fy[i]) / len(i)
            back = np.outer(err, params[2]) * (1 - h * h)
            grads = [fx[i].T @ back + 1e-4 * params[0], back.sum(0), h.T @ err + 1e-4 * params[2], err.sum(keepdims=True)]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    test = held if held.any() else ~held
    z = net.logits(x[test].astype(np.float64)) * np.where(y[test] > 0, 1.0, -1.0)
    net.temperature = float(min(np.geomspace(0.25, 16, 49), key=lambda t: np.logaddexp(0, -z / t).sum()))
    return net


def score(docs: DataFrame, labels: DataFrame, usable, shape: Shape = Shape(), label: str = "quality") -> DataFrame:
    """doc_id, score of every row of docs. usable: a condition on labels.doc_id for the rows to learn from."""
    rows = common.table(features(docs, word_vectors(docs, shape)), "features")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = known.count()
    turn = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 20))
    chosen = known.where(turn < int(min(1.0, 0.95 * shape.sample / max(1, total)) * (1 << 20)) if total > shape.sample else F.lit(True))
    once = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x"))  # a repeated doc_id teaches once
    taken = sorted(once.select("doc_id", "y", "x").collect())
    x = np.array([np.frombuffer(r["x"], np.float32) for r in taken]).reshape(len(taken), 2 * shape.dims + 2)
    shared = docs.sparkSession.sparkContext.broadcast(train(x, np.array([r["y"] for r in taken], np.int64), shape.hidden))

    def run(given):
        own = shared.value
        for batch in given:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batches.strings(batch.column("x"))), np.float32).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.scores(x.astype(np.float64)))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
