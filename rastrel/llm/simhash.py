"""Near duplicates by SimHash, found with anchor-point covering.

Fingerprints of 64 bits are linked at `RADIUS` = 3 or fewer differing bits. Two fingerprints that close differ in at most
one bit of one 31-bit half (bits 0-30 or 32-62). On each half the anchors are the words of the perfect [31, 26] Hamming
code, whose covering radius is 1: the anchor nearest to one fingerprint is within 1 + 1 of the other, so each fingerprint
goes to every anchor within 2 bits of its half (16 of them, or 1 for a code word) and every linked pair meets at an
anchor. Anchors come from the syndrome; no list of them is kept. Only distinct fingerprints are replicated.

At an anchor, small groups are compared pair by pair; a large one is searched from one fingerprint to the next among
those not yet reached, which gives a spanning forest: no connection is lost and copies aren't expanded into all pairs.

Defined cases: a null text is like an empty one; a text without words has fingerprint zero, linked like any other; fewer
than `size` words are one shingle; a null doc_id takes no part in the smallest id of a component, and a component of
such rows alone has a null id; repeated rows share a fingerprint; texts of any length are read whole; keep_one() keeps all
columns, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, common
from .components import components

RADIUS = 3
SMALL = 24
WIDE = 20_000
FLUSH = 1_000_000


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of one text's word shingles: XXH64 with seed 42, majority by bit, as an unsigned integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def text_hash(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("string"))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a long) of every row."""

    def run(given):
        for batch in batches.slices(given, "text"):
            found = np.array([fingerprint(t or b"", size) for t in batches.raw(batch.column("text"))], np.uint64)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(docs).alias("text_hash"))
    return cut.mapInArrow(run, "doc_id long, text_hash long, fp long")


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and code words: of each 31-bit value, every Hamming code word within 2 bits."""
    syndrome = np.zeros(len(half), np.int64)
    for i in range(1, 32):
        syndrome ^= np.where(half >> (i - 1) & 1, i, 0)
    rows = np.arange(len(half))
    near = np.where(syndrome, half ^ (1 << np.maximum(syndrome - 1, 0)), half)
    out_rows, out_words = [rows], [near]
    for i in range(1, 32):
        j = i ^ syndrome
        ok = (syndrome > 0) & (i < j)  # each pair once; j is 0 where i alone leads to the nearest word
        out_rows.append(rows[ok])
        out_words.append(half[ok] ^ (1 << (i - 1)) ^ (1 << (j[ok] - 1)))
    return np.concatenate(out_rows), np.concatenate(out_words)


def _replicate(given):
    for batch in given:
        for at in range(0, batch.num_rows, 20_000):
            fp = batch.column("fp").to_numpy()[at : at + 20_000]
            for part in (0, 1):
                rows, words = anchors(fp >> (32 * part) & 0x7FFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(words | part << 31), pa.array(fp[rows])], ["anchor", "fp"])


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    if len(values) <= WIDE:
        return _search(values, radius)
    varied = [byte for byte in range(0, 64, 8) if ((values >> byte ^ values[0] >> byte) & 0xFF).any()]
    if len(varied) <= radius:  # a pair may differ in all of these bytes, so it is looked for by the bits in which it may differ
        return _flips(values, [byte + i for byte in varied for i in range(8)], radius)
    found = []  # else a pair has one of these bytes in common, and is looked for among the values that share it
    for byte in varied:
        key = values >> byte & 0xFF
        order = np.argsort(key, kind="stable")
        for run in np.split(values[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(run) > 1:
                found += _forest(run, radius)
    return found


def _flips(values: np.ndarray, bits: list[int], radius: int) -> list[tuple[int, int]]:
    """All links among distinct values that differ in these bits only."""
    ordered, found = np.sort(values), []
    for r in range(1, radius + 1):
        for some in combinations(bits, r):
            other = ordered ^ np.bitwise_or.reduce(np.int64(1) << np.array(some))
            at = np.minimum(np.searchsorted(ordered, other), len(ordered) - 1)
            own = np.flatnonzero((ordered[at] == other) & (ordered < other))
            found += zip(ordered[own].tolist(), other[own].tolist())
    return found


def _search(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    found, left = [], values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if close.any():
                near, left = left[close], left[~close]
                found += [(int(x), int(y)) for y in near]
                queue += list(near)
    return found


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def add(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self):
        pairs = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def _link(radius: int):
    def groups(keys: np.ndarray, fps: np.ndarray, union: _Union) -> None:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(keys)]]))
        small = np.repeat(sizes <= SMALL, sizes)
        most = int(sizes[sizes <= SMALL].max(initial=0))
        for k in range(1, most):
            near = (keys[k:] == keys[:-k]) & small[k:] & (np.bitwise_count((fps[k:] ^ fps[:-k]).view(np.uint64)) <= radius)
            for i in np.flatnonzero(near):
                union.add(int(fps[i]), int(fps[i + k]))
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            for x, y in _forest(fps[s : s + n], radius):
                union.add(x, y)

    def run(given):
        union, keys, fps = _Union(), [], []
        for batch in given:
            if not batch.num_rows:
                continue
            k, f = (batch.column(c).to_numpy() for c in ("anchor", "fp"))
            last = int(np.searchsorted(k, k[-1]))  # the last anchor's rows may go on in the next batch
            if last or (keys and keys[-1][-1] != k[0]):
                groups(np.concatenate([*keys, k[:last]]), np.concatenate([*fps, f[:last]]), union)
                keys, fps = [], []
            keys.append(k[last:])
            fps.append(f[last:])
            if len(union.up) > FLUSH:
                yield union.stars()
        if keys:
            groups(np.concatenate(keys), np.concatenate(fps), union)
        yield union.stars()

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column fp) within the radius, at most 3."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the covering is made for a radius of 3 at most")
    spread = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    parts = common.text_partitions(distinct.sparkSession)
    return spread.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_link(radius), "u long, v long")


def _classified(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """doc_id, text_hash, fp, least (struct none, doc_id, text_hash: the component's first row) of every row."""
    rows = common.table(fingerprints(docs, size), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = common.table(rows.groupBy("fp").agg(first.alias("least")), "classes")
    roots = components(links(classes, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    known = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("least"))
    return rows.join(common.table(known.select("fp", "root").join(least, "root").select("fp", "least"), "named"), "fp")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), component_id (the smallest doc_id of the component) of every row."""
    return _classified(docs, size, radius).select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, radius: int = RADIUS) -> DataFrame:
    """The documents with one row of each component: the smallest doc_id's, null ids last; repeated rows count once."""
    found = _classified(docs, size, radius).select("doc_id", "text_hash", "least")
    is_least = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    here, there, none, digest = common.fresh(docs, "_id", "_digest", "_none", "_text_hash")
    rows = found.where(is_least).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = common.table(rows, "kept")
    kept = rows.select(F.coalesce("doc_id", F.lit(-1)).alias(here), F.col("text_hash").alias(there), F.col("doc_id").isNull().alias(none))
    marked = docs.withColumn(digest, text_hash(docs))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)) == F.col(here)) & (F.col(digest) == F.col(there)) & (docs["doc_id"].isNull() == F.col(none))
    one = marked.join(kept, same, "left_semi")
    if rows.where("n > 1").limit(1).count():
        one = one.dropDuplicates(["doc_id", digest])
    return one.drop(digest)
