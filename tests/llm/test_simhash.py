import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rastrel.llm import simhash
from rastrel.llm.components import components

SCHEMA = "doc_id long, text string, FP string, Anchor int"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=3):
    """fp -> smallest fp reachable."""
    values, seen = sorted(set(values)), {}
    for v in values:
        if v in seen:
            continue
        queue, seen[v] = [v], v
        while queue:
            x = queue.pop()
            for y in values:
                if y not in seen and (x ^ y).bit_count() <= radius:
                    seen[y] = v
                    queue.append(y)
    return seen


def brute(rows):
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    of = plain_components([f for _, f in fps])
    least = {}
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return sorted(((i, f, least.get(of[f])) for i, f in fps), key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    rows, n = [], 0
    for _ in range(25):
        words = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(1, 4)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own), "x", 1))
            n += 1
    rows += [(900, None, None, None), (901, "", "x", 1), (902, " \t\n", "x", 1), (903, "one", "x", 1), (904, "ONE", "x", 1), (905, "a b", "x", 1)]
    rows += [(None, "one", "x", 1), (None, "nobody else", "x", 1), rows[0], rows[0], (906, "a\x85b\x1cc É é", "x", 1), (907, "w " * 3_000, "x", 1)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_one_of_each_component_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    of = {(r[0], r[1]): r[2] for r in [(i, t, plain_components([plain_fingerprint(x[1]) for x in rows])[plain_fingerprint(t)]) for i, t, *_ in set(rows)]}
    groups = [of[(r["doc_id"], r["text"])] for r in kept.collect()]
    assert len(groups) == len(set(groups)) == len(set(of.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_links_lose_no_connection(spark):
    rng = random.Random(5)
    values = []
    for _ in range(40):
        x = rng.getrandbits(64)
        values.append(x)
        for _ in range(rng.choice([0, 2, 60])):  # a large group meets at one anchor
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            values.append(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()
    mask = (1 << 64) - 1
    root = {v: v for v in set(values)} | {r["u"] & mask: r["v"] & mask for r in found}
    groups = lambda of: {frozenset(k for k in of if of[k] == r) for r in set(of.values())}
    assert groups(root) == groups(plain_components(values))


def test_wide_groups_split_by_bytes():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 20, 30_000))
    values = values[: simhash.WIDE + 500]
    union, plain = simhash._Union(), simhash._Union()
    for x, y in simhash._forest(values, 1):
        union.add(x, y)
    for x, y in simhash._search(values, 1):
        plain.add(x, y)
    assert [union.root(int(v)) for v in values] == [plain.root(int(v)) for v in values]


def test_anchors_cover():
    rng = random.Random(2)
    for _ in range(200):
        x = rng.getrandbits(31)
        y = x ^ (1 << rng.randrange(31)) if rng.random() < 0.8 else x
        a, b = (set(simhash.anchors(np.array([v], np.int64))[1].tolist()) for v in (x, y))
        assert a & b and len(a) in (1, 16)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert got.agg(F.count("*"), F.max("v")).first() == (60 + 199, 1000)
    assert got.where("u <= 60 and v != 0").count() == 0


def test_keep_one_writes_no_table_of_all_rows_but_the_fingerprints(spark, monkeypatch):
    """Scratch files are few: what is read once is not written."""
    from rastrel.llm import common

    names, table = [], common.table
    monkeypatch.setattr(common, "table", lambda df, name: names.append(name) or table(df, name))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y z w v")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3]
    assert sorted(set(names) - {"edges", "large"}) == ["classes", "fingerprints", "kept", "named"]
