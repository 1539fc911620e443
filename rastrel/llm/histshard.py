"""Sharding by histogram sort: splitters of the key order are refined by exact counts, then rows are exchanged once.

The key of a row is (64-bit hash of its text, doc_id), so equal texts lie next to each other and a text that a third of
all rows share is still split, by doc_id. The law is `bytes`: shard i ends at the key below which i+1 fortieths of all
bytes lie. For each of those targets a bracket of keys is kept; a pass over the slim table (key, size) counts the exact
bytes and rows below `probes` keys spread over each open bracket, and the next pass looks between the two that enclose
the target. A target is met when a probe is within `tolerance` of a shard's bytes, or when one row is left in its
bracket; then the nearer end becomes the splitter. A pass sends each partition's sums for the probes, nothing by row.

Shards too large for one task are cut into ranges of about `range_bytes` by further splitters of the same kind; a range
is one partition of the one exchange, sorted by key, and a row's slot is its range's offset plus its place there.

Defined cases: a null text has 16 bytes and the hash of null, next to each other; a null doc_id comes before all others;
rows equal in text and doc_id have one key and stay in one shard; an empty table gives no rows; all columns of the
documents are kept, and the added ones take a trailing underscore where a name is taken.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LAW = "bytes"
EXTRA = 16


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs of unsigned 64-bit integers as byte strings in their order."""
    out = np.empty((len(high), 2), ">u8")
    out[:, 0], out[:, 1] = high, low
    return out.view("S16").ravel()


def _as_keys(probes: list[int], width: int) -> np.ndarray:
    return _keys(np.array([p // width for p in probes], np.uint64), np.array([p % width for p in probes], np.uint64))


def _row_keys(high: np.ndarray, doc_id: np.ndarray, first: int) -> np.ndarray:
    """Hashes as unsigned in signed order; the place of doc_id after the smallest one."""
    return _keys(high.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), doc_id.astype(np.int64).view(np.uint64) - np.uint64(first & (1 << 64) - 1))


def _count(slim: DataFrame, probes: list[int], width: int, first: int) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe."""
    edges = _as_keys(probes, width)

    def run(given):
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in given:
            high, doc, n = (batch.column(c).to_numpy() for c in ("h", "d", "size"))
            at = np.searchsorted(edges, _row_keys(high, doc, first), "right")
            np.add.at(size, at, n)
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, size[some], rows[some])], ["at", "size", "n"])

    sums = slim.mapInArrow(run, "at long, size long, n long").groupBy("at").agg(F.sum("size"), F.sum("n")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for at, s, n in sums:
        size[at], rows[at] = s, n
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()))


def splitters(slim: DataFrame, parts: int, tolerance: float, probes: int = 8) -> tuple[list[int], list[tuple[int, int]], int, int]:
    """(parts - 1 keys, (bytes, rows) below each, width, first doc_id) for a table h, d, size; a key is (h + 2**63) * width + d - first."""
    total, n, first, last = slim.agg(F.sum("size"), F.count("*"), F.min("d"), F.max("d")).first()
    width = last - first + 1
    ends = {0: (0, 0), width << 64: (total, n)}
    targets = [total * i // parts for i in range(1, parts)]
    slack, chosen = tolerance * total / parts, {}
    while len(chosen) < len(targets):
        known, asked = sorted(ends), set()
        below = [ends[k][0] for k in known]
        for t in targets:
            if t in chosen:
                continue
            i = max(1, bisect_left(below, t))
            low, high = known[i - 1], known[i]
            near = min((low, high), key=lambda k: abs(ends[k][0] - t))
            if abs(ends[near][0] - t) <= slack or ends[high][1] - ends[low][1] <= 1 or high - low <= 1:
                chosen[t] = near
            else:
                step = (high - low) / (probes + 1)
                asked |= {k for j in range(1, probes + 1) if low < (k := low + (high - low) * j // (probes + 1)) < high} if step >= 2 else set(range(low + 1, min(high, low + probes + 2)))
        if asked:
            ends |= dict(zip(sorted(asked), _count(slim, sorted(asked), width, first)))
    keys = [chosen[t] for t in targets]
    return keys, [ends[k] for k in keys], width, first


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, range_bytes: int = 512 << 20) -> DataFrame:
    """The documents with size, law, shard, slot and grown_shard (null under this law), by shard and slot within partitions."""
    h, d, fine, place = common.fresh(docs, "_h", "_d", "_range", "_place")
    size, law, number, slot, grown = common.fresh(docs, "size", "law", "shard", "slot", "grown_shard")
    text = docs["text"].cast("string")
    keyed = docs.withColumns(
        {h: F.xxhash64(text), d: F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), size: (F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA).cast("long")}
    )
    real = F.when(F.col("d") > -(1 << 63), F.col("d"))
    slim = common.table(keyed.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(size).alias("size")), "keys")
    total, before = slim.agg(F.sum("size"), F.min(real)).first()
    if total is None:
        empty = {size: F.lit(0).cast("long"), law: F.lit(LAW), number: F.lit(0), slot: F.lit(0).cast("long"), grown: F.lit(None).cast("int")}
        return docs.withColumns(empty).where(F.lit(False))
    null_as = (before or 0) - 1  # nulls first, without stretching the range of keys
    slim = slim.withColumn("d", F.coalesce(real, F.lit(null_as).cast("long")))
    each = max(1, math.ceil(total / shards / range_bytes))
    keys, below, width, first = splitters(slim, shards * each, tolerance)
    edges = _as_keys(keys, width)
    rows = [0] + [n for _, n in below]
    offsets = np.array([rows[i] - rows[i - i % each] for i in range(shards * each)], np.int64)

    @F.pandas_udf("n int, slot long")
    def range_of(high: pd.Series, doc: pd.Series) -> pd.DataFrame:
        n = np.searchsorted(edges, _row_keys(high.to_numpy(), doc.to_numpy(), first), "right")
        return pd.DataFrame({"n": n.astype(np.int32), "slot": offsets[n]})

    named = F.when(F.col(d) > -(1 << 63), F.col(d)).otherwise(F.lit(null_as).cast("long"))
    dealt = keyed.withColumn(d, named).withColumn(fine, range_of(F.col(h), F.col(d)))
    dealt = dealt.repartitionById(shards * each, F.col(fine)["n"]).sortWithinPartitions(h, d)
    dealt = dealt.withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    dealt = dealt.withColumns({law: F.lit(LAW), number: F.floor(F.col(fine)["n"] / each).cast("int"), slot: F.col(fine)["slot"] + F.col(place), grown: F.lit(None).cast("int")})
    return dealt.drop(h, d, fine, place)
