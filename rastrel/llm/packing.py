"""Packing by power-of-two decomposition: a document's ids are cut into pieces whose lengths are powers of two.

A document of n ids gives n // most pieces of `most` ids, then one piece for each binary digit 1 of the rest, longest
first. Every piece is a whole sequence, so no sequence crosses documents and none is padded; sequences of one length form
a bucket. Sequence ids are dense and bucket-major (all of the shortest length first), so a reader can take one bucket as
one range of ids.

One pass tokenizes and writes the pieces to the shared folder with their rank within (task, length); then a count for
each (task, length) gives the offsets. Nothing is shuffled but those counts.

Defined cases: a null or empty text is the end id alone, one piece of length 1; a null doc_id stays null; repeated rows
give repeated pieces with sequence ids of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches, common, tokens

SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, task int, place long"


def piece_lengths(n: int, most: int) -> list[int]:
    """most, most, ..., then the binary digits of the rest from the highest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(vocabulary: str, end_id: int, most: int):
    def run(given):
        task, places = TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches.slices(given, "text"):
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batches.strings(batch.column("text"))]
            rows: list[tuple] = []
            for doc_id, raw in zip(doc_ids, tokens.encoder(vocabulary).batch(texts)):
                raw += end
                wide, start, n = tokens.as_ids(raw).astype("<u4").tobytes(), 0, len(raw) // 2
                for length in piece_lengths(n, most):
                    stop = start + length
                    rows.append((doc_id, start, length, raw[2 * start : 2 * stop], zlib.crc32(wide[4 * start : 4 * stop]), n, task, places[length]))
                    places[length] += 1
                    start = stop
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "task", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, most: int = 1024) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian uint16), ids_crc32 (of the ids as uint32), doc_tokens, sequence_id, offset.

    most: the longest piece, a power of two. A piece fills its sequence, so offset is always 0.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = common.table(cut.mapInArrow(_pieces(vocabulary, end_id, most), SCHEMA), "pieces")
    counted = common.table(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counted")
    sums, base = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, F.lit(0).cast("long")
    for length in sums:  # a row for each power of two at most
        base = F.when(F.col("length") == length, F.lit(sum(n for k, n in sums.items() if k < length)).cast("long")).otherwise(base)
    placed = common.small_join(pieces, common.offsets(counted, ["length"], "task", "n", "before"), ["length", "task"])
    number = (base + F.col("before") + F.col("place")).alias("sequence_id")
    return placed.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", number, F.lit(0).cast("long").alias("offset"))
