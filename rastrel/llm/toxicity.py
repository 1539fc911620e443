"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over all their terms through a block-max inverted index.

Examples are at most about `examples` labelled documents of each class, chosen by a hash of doc_id. The vector space has every
term of every example: (1 + log count) * idf for each, with document counts over all documents, and length 1. A word that no
example has changes neither the order of the examples nor their votes, as it scales all similarities of a document alike; it
is not in the length. Examples lie in blocks of `block`; for each term and block the index keeps the largest weight, so a block
whose sum of largest weights can't reach the k-th best similarity found is left out, and the k nearest are exact. The
`common` most frequent terms are multiplied as a matrix for many documents at once, the others read from postings. Equal
similarities go to the example that comes first.

A vote weighs similarity squared times how many labelled documents its example stands for. Some of the terms are listed as
tied to toxicity: log-likelihood ratio at or above `evidence`, `lift` times as frequent in toxic examples, in at least `least`
different texts, and after at least half as many different words as it has toxic texts, which terms of one copied passage
aren't; at most `terms`. A document with listed terms also gets a share of votes from the examples nearest by these alone, and
the two shares are averaged. The share of toxic votes is turned into a probability by an isotonic fit on the examples, each
scored without itself and its copies, one fit for those with listed terms and one for those without; a document without any
term of an example has no toxic votes. Evidence: the nearest examples in the whole space and the listed terms.

Two passes read whole texts of all documents (counts, then scores), and joins with the bounded list read those of the examples.

Defined cases: a null or empty text has no terms; a doc_id with several labels takes the largest; null labels and null
doc_ids teach nothing; without labels of both kinds each score is the share of 1 among those there are, or 0.5; repeated
rows get the same score; a doc_id with several texts is one example; texts of any length are read whole; other columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, common


@dataclass(frozen=True)
class Shape:
    examples: int = 4000
    terms: int = 2048
    least: int = 5
    evidence: float = 15.0
    lift: float = 3.0
    block: int = 64
    k: int = 15
    common: int = 512


def unit(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[index]
    return w / np.sqrt((w * w).sum())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each size, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class Index:
    """Postings by term and block, each block's largest weight of each term, and the commonest terms as a matrix."""

    block: int
    size: int
    cells: np.ndarray
    blocks: np.ndarray
    largest: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    weights: np.ndarray
    column: np.ndarray
    matrix: np.ndarray
    read: int = field(default=0)

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int, common: int = 0) -> Index:
        blocks = max(1, -(-len(vectors) // block))
        sizes = [len(t) for t, _ in vectors]
        doc = np.repeat(np.arange(len(vectors), dtype=np.int32), sizes)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        column = np.full(terms, -1, np.int32)
        often = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:common]
        column[often] = np.arange(len(often))
        matrix = np.zeros((len(often), len(vectors)))
        dense = column[term] >= 0
        matrix[column[term[dense]], doc[dense]] = weight[dense]
        doc, weight, cell = doc[~dense], weight[~dense], term[~dense].astype(np.int64) * blocks + doc[~dense] // block
        del term, dense
        order = np.argsort(cell, kind="stable")
        doc, weight, cell = doc[order], weight[order], cell[order]
        del order
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        cells = cell[starts]
        largest = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0)
        by_term = np.searchsorted(cells, np.arange(terms + 1) * blocks)
        return cls(block, len(vectors), by_term, (cells % blocks).astype(np.int32), largest, np.append(starts, len(doc)), doc, weight, column, matrix)

    def products(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms in the matrix add to each vector's similarity to each example."""
        left = np.zeros((len(vectors), len(self.matrix)))
        for row, (t, w) in zip(left, vectors):
            some = self.column[t] >= 0
            row[self.column[t[some]]] = w[some]
        return left @ self.matrix

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, product: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples and similarities of the k nearest with any, best first; ties by example. product: this vector's row of products()."""
        blocks = max(1, -(-self.size // self.block))
        n = self.cells[terms + 1] - self.cells[terms]
        cells, by = _ranges(self.cells[terms], n), np.repeat(weights, n)
        of = self.blocks[cells]
        bound = np.bincount(of, self.largest[cells] * by, blocks)
        if len(self.matrix):
            product = self.products([(terms, weights)])[0] if product is None else product
            bound = bound + np.maximum.reduceat(product, np.arange(0, self.size, self.block))
        order = np.argsort(-bound, kind="stable")
        order = order[: int((bound > 0).sum())]
        best_docs, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, max(1, -(-4 * k // self.block))
        while at < len(order):
            if len(best) == k and bound[order[at]] < best[-1] - 1e-9:
                break
            some = order[at : at + step]
            if len(best) == k:
                some = some[bound[some] >= best[-1] - 1e-9]
            at += step
            step = len(order)
            chosen = np.zeros(blocks, bool)
            chosen[some] = True
            on = chosen[of]
            sizes = self.starts[cells[on] + 1] - self.starts[cells[on]]
            where = _ranges(self.starts[cells[on]], sizes)
            self.read += len(where)
            sims = np.bincount(self.docs[where], self.weights[where] * np.repeat(by[on], sizes), self.size)
            if len(self.matrix):
                sims = sims + np.where(np.repeat(chosen, self.block)[: self.size], product, 0.0)
            docs = np.flatnonzero(sims > (best[-1] - 1e-9 if len(best) == k else 0.0))
            if len(docs) > 4 * k:
                docs = docs[sims[docs] >= np.partition(sims[docs], -k)[-k] - 1e-9]
            docs, sims = np.concatenate([best_docs, docs]), np.concatenate([best, sims[docs]])
            top = np.lexsort((docs, -np.round(sims, 12)))[:k]
            best_docs, best = docs[top], sims[top]
        return best_docs, best


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing fit: equal values of x pool first, then neighbours that fall."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        on = x == v
        pools.append([v, v, float((w[on] * y[on]).sum()), float(w[on].sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, s, n = pools.pop()
            pools[-1][1:] = [hi, pools[-1][2] + s, pools[-1][3] + n]
    knots = [(a, (s + 0.25) / (n + 0.5) if n < 10 else s / n) for lo, hi, s, n in pools for a in dict.fromkeys((lo, hi))]
    return np.array([k for k, _ in knots]), np.maximum.accumulate([p for _, p in knots])


@dataclass
class Model:
    """idf of all terms of the examples, the listed ones first; index: over all, of_listed: over the listed ones."""

    idf: np.ndarray
    listed: int
    index: Index | None
    of_listed: Index | None
    rows: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    texts: np.ndarray
    knots: list[tuple[np.ndarray, np.ndarray]]
    none: float
    k: int
    memory: dict = field(default_factory=dict)

    def share(self, near: np.ndarray, sims: np.ndarray) -> float:
        votes = sims * sims * self.weights[near]
        return float((votes * self.labels[near]).sum() / votes.sum()) if len(near) else 0.0

    def votes(self, vector: tuple[np.ndarray, np.ndarray], counts: np.ndarray, product: np.ndarray, without: int | None = None) -> tuple[int, float, np.ndarray, np.ndarray]:
        """Whether it has listed terms, the share of toxic votes, and the nearest in the whole space; without: leave out this text."""
        extra = 0 if without is None else int((self.texts == without).sum())

        def kept(near, sims):
            if without is None:
                return near, sims
            other = self.texts[near] != without
            return near[other][: self.k], sims[other][: self.k]

        near, sims = kept(*self.index.nearest(*vector, self.k + extra, product))
        share, some = self.share(near, sims), vector[0] < self.listed
        if not some.any():
            return 0, share, near, sims
        t = vector[0][some]
        by, like = self.of_listed.nearest(t, unit(t, counts[some], self.idf), self.k + extra)
        return 1, (share + self.share(*kept(self.rows[by], like))) / 2, near, sims

    def score(self, given: list[tuple[np.ndarray, np.ndarray]], batch: int = 256) -> list[tuple[float, list, list]]:
        """Probability, the nearest examples' doc_ids and their similarities, for the terms and counts of each text."""
        if self.index is None:
            return [(self.none, [], [])] * len(given)
        keys = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() if len(t) else b"" for t, c in given]
        if len(self.memory) > 20_000:
            self.memory.clear()
        self.memory[b""] = self.none, [], []
        new = list({k: i for i, k in enumerate(keys) if k not in self.memory}.values())
        for a in range(0, len(new), batch):
            some = [given[i] for i in new[a : a + batch]]
            units = [(t, unit(t, c, self.idf)) for t, c in some]
            for i, (_, c), own, product in zip(new[a : a + batch], some, units, self.index.products(units)):
                kind, share, near, sims = self.votes(own, c, product)
                self.memory[keys[i]] = float(np.interp(share, *self.knots[kind])), self.ids[near].tolist(), sims.tolist()
        return [self.memory[k] for k in keys]


def _example_terms(given):
    """term, toxic and clean different texts that hold it, of each slice; the same text in a slice counts once."""
    for batch in batches.slices(given, "text"):
        distinct, index, starts = batches.words(batch.column("text"))
        forms, labels, counts, seen = batches.strings(batches.terms(distinct)), batch.column("y").to_pylist(), Counter(), set()
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            key = hash((labels[i], index[a:b].tobytes()))
            if key not in seen:
                seen.add(key)
                counts.update((f, labels[i]) for f in {forms[j] for j in np.unique(index[a:b])} if f)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int64()), pa.array(counts.values(), pa.int64())], ["term", "y", "n"])


def _contexts(terms: list[str]):
    def run(given):
        known = pa.array(terms, pa.large_string())
        for batch in batches.slices(given, "text"):
            distinct, index, starts = batches.words(batch.column("text"))
            forms = batches.terms(distinct)
            number = pc.fill_null(pc.index_in(forms, known), -1).to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, np.int32)
            hits = np.flatnonzero(number >= 0)
            hits = hits[~np.isin(hits, starts)]
            pairs = np.unique(np.stack([number[hits], index[hits - 1]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int32)), forms.take(pa.array(pairs[1])).cast(pa.string())], ["t", "before"])

    return run


def choose_terms(examples: DataFrame, sizes: tuple[int, int], shape: Shape) -> list[str]:
    """The terms tied to label 1: bounded by shape.terms, strongest first."""
    seen = examples.mapInArrow(_example_terms, "term string, y long, n long")
    both = seen.groupBy("term").agg(F.sum(F.col("n") * F.col("y")).alias("a"), F.sum(F.col("n") * (1 - F.col("y"))).alias("b"))
    clean, toxic = float(sizes[0]), float(sizes[1])
    a, b, n = F.least("a", F.lit(toxic)), F.least("b", F.lit(clean)), F.lit(clean + toxic)
    ea, eb = (a + b) * toxic / n, (a + b) * clean / n
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (part(a, ea) + part(b, eb) + part(toxic - a, toxic - ea) + part(clean - b, clean - eb))
    good = both.where((a + b >= shape.least) & ((a + 0.5) / toxic >= (b + 0.5) / clean * shape.lift)).select("term", "a", ratio.alias("g")).where(F.col("g") >= shape.evidence)
    tied = [(r["term"], r["a"]) for r in good.orderBy(F.desc("g"), "term").limit(2 * shape.terms).collect()]
    if not tied:
        return []
    toxic_texts = examples.where("y = 1").select("text").mapInArrow(_contexts([t for t, _ in tied]), "t int, before string")
    ways = {r["t"]: r["n"] for r in toxic_texts.distinct().groupBy("t").agg(F.count("*").alias("n")).collect()}
    return [t for i, (t, a) in enumerate(tied) if ways.get(i, 0) >= max(shape.least, a / 2)][: shape.terms]


def _numbered(batch: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's terms begin, then the numbers (rising in a text) and counts of the known terms."""
    distinct, index, starts = batches.words(batch.column("text"))
    number = pc.fill_null(pc.index_in(batches.terms(distinct), known), -1).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, np.int32)
    flat = number[index] if len(index) else np.zeros(0, np.int32)
    hits = np.flatnonzero(flat >= 0)
    row = np.searchsorted(starts, hits, "right") - 1
    cells, times = np.unique(row.astype(np.int64) * max(1, len(known)) + flat[hits], return_counts=True)
    rows, t = np.divmod(cells, max(1, len(known)))
    return np.searchsorted(rows, np.arange(batch.num_rows + 1)), t, times


def _bags(given):
    """Each example's different terms and their counts."""
    for batch in batches.slices(given, "text"):
        known = batches.terms(batches.words(batch.column("text"))[0]).unique()
        known = known.filter(pc.not_equal(known, ""))
        edges, t, times = _numbered(batch, known)
        at = pa.array(edges, pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "y")), pa.ListArray.from_arrays(at, known.take(pa.array(t)).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))], ["doc_id", "digest", "y", "t", "c"])


def document_counts(docs: DataFrame, terms: pa.Array) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(given):
        known, rows = shared.value, 0
        held = np.zeros(len(known), np.int64)
        for batch in batches.slices(given, "text"):
            held += np.bincount(_numbered(batch, known)[1], minlength=len(known))
            rows += batch.num_rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], rows))], ["t", "n"])

    found = docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n = (found.column(c).to_numpy() for c in ("t", "n"))
    out = np.zeros(len(terms), np.int64)
    out[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), out


def fit(rows: list, idf: np.ndarray, listed: int, stands_for: tuple[float, float], shape: Shape) -> Model:
    """rows: doc_id, y, digest, t, c of the examples."""
    # examples with the same strongest term lie together, so that blocks differ in their largest weights
    rows = [(r, unit(r[3], r[4], idf)) for r in rows if len(r[3])]
    rows.sort(key=lambda x: (int(x[0][3][np.argmax(x[1])]), x[0][0], x[0][2]))
    units, counts = [(r[3], w) for r, w in rows], [r[4] for r, _ in rows]
    labels = np.array([r[1] for r, _ in rows], np.float64)
    weights = np.where(labels > 0, stands_for[1], stands_for[0])
    with_listed = [(int(t[t < listed][np.argmax(w[t < listed])]), i) for i, (t, w) in enumerate(units) if (t < listed).any()]
    order = [i for _, i in sorted(with_listed)]
    parts = [(t[t < listed], unit(t[t < listed], c[t < listed], idf)) for (t, _), c in ((units[i], counts[i]) for i in order)]
    index = Index.build(units, len(idf), shape.block, shape.common)
    model = Model(idf, listed, index, Index.build(parts, listed, shape.block) if parts else None, np.array(order, np.int64), labels, weights, np.array([r[0] for r, _ in rows], np.int64), np.array([r[2] for r, _ in rows], np.int64), [], 0.0, shape.k)
    kinds, shares = np.zeros(len(units), np.int64), np.zeros(len(units))
    for a in range(0, len(units), 256):
        for i, product in enumerate(index.products(units[a : a + 256]), a):
            kinds[i], shares[i], _, _ = model.votes(units[i], counts[i], product, model.texts[i])
    prior = float(np.average(labels, weights=weights))
    model.knots = [isotonic(shares[kinds == k], labels[kinds == k], weights[kinds == k]) if (kinds == k).any() else (np.zeros(1), np.full(1, prior)) for k in (0, 1)]
    model.none = float(np.interp(0.0, *model.knots[0]))
    return model


def score(docs: DataFrame, labels: DataFrame, usable, shape: Shape = Shape(), label: str = "toxic") -> DataFrame:
    """doc_id, score, nearest (doc_ids), similarities, terms (listed) of every row of docs. usable: which labels.doc_id to learn from."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("long")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total, toxic = sum(sizes.values()), sizes.get(1, 0)
    turn = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 20))
    share = [min(1.0, shape.examples / max(1, n)) for n in (total - toxic, toxic)]
    chosen = known.where(turn < F.when(F.col("y") == 1, int(share[1] * (1 << 20))).otherwise(int(share[0] * (1 << 20))))
    chosen = common.table(chosen, "chosen")  # about 2 * shape.examples rows, and safe to broadcast
    text = F.col("text").cast("string").alias("text")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    rows, names, listed = [], [], []
    if 0 < toxic < total:
        texts = whole.join(F.broadcast(chosen), "doc_id").withColumn("digest", F.xxhash64("text"))
        texts = texts.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.min_by("text", "digest").alias("text"), F.first("y").alias("y"))  # a repeated doc_id is one example
        texts = common.table(texts, "examples")
        picked = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(picked) == 2:
            listed = choose_terms(texts.select("text", "y"), (picked[0], picked[1]), shape)
            rows, names = _examples(texts, listed)
            pa.default_memory_pool().release_unused()
    if len({r[1] for r in rows}) < 2:
        model, names, listed = Model(np.zeros(0), 0, None, None, *[np.zeros(0)] * 5, [], toxic / total if total else 0.5, shape.k), pa.array([], pa.large_string()), []
    else:
        n, held = document_counts(whole, names)
        model = fit(rows, np.log((n + 1) / (held + 1)) + 1, len(listed), (1 / share[0], 1 / share[1]), shape)
        rows.clear()
    shared = spark.sparkContext.broadcast((model, names, listed))

    def run(given):
        own, known, listed = shared.value
        for batch in batches.slices(given, "text"):
            edges, t, times = _numbered(batch, known)
            bags = [(t[a:b], times[a:b]) for a, b in zip(edges, edges[1:])]
            found = [(*f, [listed[i] for i in t[t < len(listed)]]) for f, (t, _) in zip(own.score(bags), bags)]
            kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string())]
            columns = [pa.array(x, k) for x, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "score", "nearest", "similarities", "terms"])

    return whole.mapInArrow(run, "doc_id long, score double, nearest array<long>, similarities array<double>, terms array<string>")


def _examples(texts: DataFrame, listed: list[str]) -> tuple[list, pa.Array]:
    """doc_id, y, digest, numbers and counts of each example's terms; the terms by number, the listed ones first."""
    found = texts.mapInArrow(_bags, "doc_id long, digest long, y long, t array<string>, c array<int>").toArrow().combine_chunks()
    if not found.num_rows:
        return [], pa.array([], pa.large_string())
    words, counts = found.column("t").combine_chunks(), found.column("c").combine_chunks()
    flat = words.flatten()
    first = pa.array(listed, pa.string())
    distinct = flat.unique()
    rest = distinct.filter(pc.invert(pc.is_in(distinct, first)))
    names = pa.concat_arrays([first, rest.take(pc.sort_indices(rest))])
    number, times = pc.index_in(flat, names).to_numpy(zero_copy_only=False), counts.flatten().to_numpy()
    del flat, distinct, rest
    ends, rows = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)), []
    for d, y, g, b, size in zip(*(found.column(c).to_pylist() for c in ("doc_id", "y", "digest")), ends.tolist(), pc.list_value_length(words).to_pylist()):
        order = np.argsort(number[b - size : b])
        rows.append((d, y, g, number[b - size : b][order], times[b - size : b][order]))
    return rows, names.cast(pa.large_string())
