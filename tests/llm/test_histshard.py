import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rastrel.llm import histshard


def corpus():
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 400) + str(i), "own") for i in range(900)]
    rows += [(10_000 + i, "a hot text that a third of the rows share", "own") for i in range(500)]
    return rows + [(None, "no id", "own"), (None, None, "own"), (5, rows[5][1], "own"), (20_000, None, "own"), (20_001, "", "own"), (-7, "é" * 300, "own")]


@pytest.mark.parametrize("range_bytes", [1 << 30, 2000])
def test_shards(spark, range_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string").repartition(7)
    out = histshard.shard(docs, 12, range_bytes=range_bytes)
    assert out.columns == ["doc_id", "text", "Shard", "size", "law", "shard_", "slot", "grown_shard"]
    got = out.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).collect()
    assert sorted((r["doc_id"], r["text"], r["Shard"]) for r in got if r["doc_id"] and r["text"]) == sorted(r for r in rows if r[0] and r[1])
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16 and r["crc"] == zlib.crc32((r["text"] or "").encode()) and r["grown_shard"] is None
        by[r["shard_"]].append(r)
    assert sorted(by) == list(range(12))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    mean, largest = sum(sizes) / 12, max(r["size"] for r in got)
    assert max(abs(s - mean) for s in sizes) <= largest + 2
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert len({r["shard_"] for r in got if (r["doc_id"] or 0) >= 10_000 and r["doc_id"] < 20_000}) > 1


def test_splitters_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.randrange(50), rng.randint(1, 9)) for _ in range(700)] + [(5, i, 3) for i in range(400)]
    slim = spark.createDataFrame(rows, "h long, d long, size long")
    keys, below, width, first = histshard.splitters(slim, 8, 0.0)
    key = lambda h, d: (h + (1 << 63)) * width + d - first
    total = sum(s for *_, s in rows)
    for i, (k, (size, n)) in enumerate(zip(keys, below), 1):
        inside = [s for h, d, s in rows if key(h, d) < k]
        assert (size, n) == (sum(inside), len(inside)) and abs(size - total * i / 8) <= 9


def test_few_rows_and_none(spark):
    schema = "doc_id long, text string"
    assert histshard.shard(spark.createDataFrame([], schema)).count() == 0
    got = histshard.shard(spark.createDataFrame([(1, "a"), (2, "b")], schema), 5).collect()
    assert len(got) == 2 and all(r["slot"] == 0 for r in got)
    same = histshard.shard(spark.createDataFrame([(3, "same")] * 9, schema), 4).collect()
    assert sorted(r["slot"] for r in same) == list(range(9)) and len({r["shard"] for r in same}) == 1
