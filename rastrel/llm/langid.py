"""Language identification by hierarchical discrimination.

A text's features are the relative frequencies of its byte trigrams, hashed to `dims` buckets, after lower-casing and
after everything but letters has become single spaces. One-versus-rest linear support vector machines choose the language
family; within it, one linear machine for each pair of its languages votes, and the sum of margins breaks ties. The score
is the calibrated probability of the family times that of the language within it.

Training takes at most `sample` documents in all, as many of each language, chosen by a hash of the text; executors turn
them into feature vectors, so the driver holds sample x dims numbers whatever the lengths. Scoring reads whole texts.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text if no labelled one exists;
with one language in training that language is predicted with score 1; lang values that are null are not learnt from;
repeated rows get the same prediction, and teach once; texts of any length are read whole; equal votes go by the sum of
margins, then by name; all columns are kept, and added ones take a trailing underscore where a name is taken; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import batches, common

#: Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"
_CHUNK = 1 << 20
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only-{lang}")


def normal(text: str | None) -> bytes:
    """Lower-case letters in words between single spaces; empty if there is no letter."""
    if not text:
        return b""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    out = b" ".join(words)
    if not out or not (any(97 <= c <= 122 for c in out[:64]) or any(map(str.isalpha, text))):
        return b""
    return b" " + out + b" "


def _buckets(raw: bytes, dims: int):
    """Hashed trigrams, a chunk at a time."""
    for at in range(0, max(1, len(raw) - 2), _CHUNK):
        x = np.frombuffer(raw, np.uint8, min(_CHUNK + 2, len(raw) - at), at).astype(np.uint32)
        code = x[:-2] | x[1:-1] << 8 | x[2:] << 16
        yield (code * np.uint32(2654435761) >> np.uint32(32 - (dims.bit_length() - 1))).astype(np.int64)


def features(raw: bytes, dims: int) -> np.ndarray:
    counts = np.zeros(dims)
    for b in _buckets(raw, dims):
        counts += np.bincount(b, minlength=dims)
    return (counts / max(1.0, counts.sum())).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighted alike, by accelerated gradient; y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    y = y.astype(x.dtype)
    v, c = np.ones(x.shape[1], x.dtype), x.dtype.type(1)
    for _ in range(12):  # the largest curvature
        z = weight * (x @ v + c)
        v, c = x.T @ z, z.sum()
        size = np.sqrt(v @ v + c * c)
        v, c = v / size, c / size
    z = weight * (x @ v + c)
    rate = x.dtype.type(1 / (2 * (v @ (x.T @ z) + c * z.sum()) + ridge))
    w = look = np.zeros(x.shape[1], x.dtype)
    b = there = x.dtype.type(0)
    for i in range(steps):
        pull = -2 * weight * y * np.maximum(0, 1 - y * (x @ look + there))
        new, new_b = look - rate * (x.T @ pull + x.dtype.type(ridge) * look), there - rate * pull.sum()
        step = x.dtype.type(i / (i + 3))
        look, there = new + step * (new - w), new_b + step * (new_b - b)
        w, b = new, new_b
    return w, float(b)


@dataclass
class Model:
    """families, and machines: each a (kind, positive, negative) with a column of weights."""

    langs: list[str]
    families: list[str]
    machines: list[tuple[str, str, str]]
    weights: np.ndarray
    biases: np.ndarray
    slopes: tuple[float, float]
    dims: int

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return UNKNOWN, 0.0
        by_family = {p: m for (kind, p, _), m in zip(self.machines, margins) if kind == "family"}
        ranked = sorted(self.families, key=lambda f: -by_family.get(f, 0.0))
        best, sure = ranked[0], 1.0
        if len(ranked) > 1:
            sure = _sigmoid(self.slopes[0] * (by_family[ranked[0]] - by_family[ranked[1]]))
        langs = [x for x in self.langs if family(x) == best]
        votes = {x: [0, 0.0] for x in langs}
        for (kind, p, n), m in zip(self.machines, margins):
            if kind == "pair" and p in votes:
                votes[p if m >= 0 else n][0] += 1
                votes[p][1] += m
                votes[n][1] -= m
        order = sorted(langs, key=lambda x: (-votes[x][0], -votes[x][1], x))
        if len(order) > 1:
            first, second = order[:2]
            m = next(m if p == first else -m for (k, p, n), m in zip(self.machines, margins) if k == "pair" and {p, n} == {first, second})
            sure *= _sigmoid(self.slopes[1] * m)
        return order[0], float(sure)

    def margins(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.machines)), 0
        for b in _buckets(raw, self.dims):
            total += self.weights[b].sum(0, dtype=np.float64)
            n += len(b)
        return total / max(1, n) + self.biases


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _slope(margins: np.ndarray) -> float:
    """The slope under which these margins, positive where right, are likeliest."""
    if not len(margins):
        return 1.0
    return float(min(np.geomspace(0.25, 32, 29), key=lambda s: np.logaddexp(0, -s * margins).sum()))


def train(labelled: DataFrame, sample: int = 1600, dims: int = 4096) -> Model:
    """labelled: text, lang. At most `sample` different texts (two of each language at least) reach the driver, as vectors."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    keys = common.table(known.select("lang", F.xxhash64("text").alias("digest")).distinct(), "digests")
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    empty = Model([], [], [], np.zeros((dims, 0), np.float32), np.zeros(0), (1.0, 1.0), dims)
    if not sizes:
        return empty
    # of each language a few more different texts than needed are drawn, and the first `each` of these in another order are taken
    each, turn = max(2, sample // len(sizes)), F.pmod(F.xxhash64(F.lit(17), "digest"), F.lit(1 << 40))
    share = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, int(min(1.0, (1.3 * each + 40) / n) * (1 << 40)))))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(18), "digest"), "digest")
    picked = keys.where(turn < share[F.col("lang")]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    texts = known.withColumn("digest", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "digest"])
    chosen = texts.groupBy("lang", "digest", "place").agg(F.first("text").alias("text"))

    def run(given):
        for batch in batches.slices(given, "text"):
            vectors = [features(normal(t), dims).tobytes() for t in batches.strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(vectors, pa.binary())], ["lang", "place", "x"])

    rows = chosen.select("lang", "place", "text").mapInArrow(run, "lang string, place int, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    taken: dict[str, list] = {}
    for r in rows:
        taken.setdefault(r["lang"], []).append(np.frombuffer(r["x"], np.float32))
    del rows
    langs = sorted(taken)
    x = np.array([v for a in langs for v in taken[a]], np.float32)
    y = np.array([a for a in langs for _ in taken[a]])
    del taken
    scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
    x *= scale
    x /= 4
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) < len(langs):
        held[:] = False
    fit = ~held
    fams = np.array([family(a) for a in y])
    families = sorted(set(fams))
    machines, columns, biases = [], [], []
    if len(families) > 1:
        for f in families:
            w, b = svm(x[fit], np.where(fams[fit] == f, 1.0, -1.0))
            machines.append(("family", f, ""))
            columns.append(w)
            biases.append(b)
    for i, a in enumerate(langs):
        for c in langs[i + 1 :]:
            if family(a) == family(c):
                on = fit & ((y == a) | (y == c))
                w, b = svm(x[on], np.where(y[on] == a, 1.0, -1.0))
                machines.append(("pair", a, c))
                columns.append(w)
                biases.append(b)
    w = np.array(columns).T if columns else np.zeros((dims, 0), np.float32)
    test = held if held.any() else fit
    margins = x[test] @ w + np.array(biases)
    own = {m: margins[:, i] for i, m in enumerate(machines)}
    by_family = np.concatenate(
        [own["family", f, ""][fams[test] == f] - np.max([own["family", g, ""][fams[test] == f] for g in families if g != f], axis=0) for f in families]
    ) if len(families) > 1 else np.zeros(0)
    by_pair = [s * own["pair", a, c][y[test] == z] for k, a, c in machines if k == "pair" for s, z in ((1, a), (-1, c))]
    slopes = (_slope(by_family), _slope(np.concatenate(by_pair) if by_pair else np.zeros(0)))
    return Model(langs, families, machines, (w * scale[:, None] / 4).astype(np.float32), np.array(biases), slopes, dims)


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, then the language and its score, under names with a trailing underscore where docs has them."""
    lang, score = common.fresh(docs, lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given_names = docs.columns

    def run(given):
        own = shared.value
        for batch in batches.slices(given, "text"):
            found = []
            for text in batches.strings(batch.column("text")):
                raw = normal(text)
                found.append(own.decide(own.margins(raw)) if raw else (UNKNOWN, 0.0))
            columns = [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*given_names, lang, score])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(lang, StringType()).add(score, DoubleType()))
