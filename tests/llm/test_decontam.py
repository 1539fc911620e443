import math
import random
from collections import Counter

import numpy as np

from rastrel.llm import batches, decontam

DOCS, ITEMS = "doc_id long, text string, N_words int", "item_id long, text string, extra int"


def forms(text):
    return [f for f in (w.strip(batches.MARKS).lower() for w in (text or "").split()) if f]


def plain(rows, items):
    """(doc_id, item_id) with a window whose weighted shingle similarity reaches 0.8, over all windows of all items."""
    items = [(i, forms(t)) for i, t, _ in items if i is not None and forms(t)]
    grams = lambda w: [tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)]
    df = Counter(g for _, w in items for g in set(grams(w)))
    weight = lambda g: math.log(1 + len(items) / (max(1, df.get(g, 0)) + 0.5))
    found = set()
    for d, t, _ in rows:
        words = forms(t)
        for i, w in items:
            b, n = Counter(grams(w)), min(len(w), len(words))
            for at in range(len(words) - n + 1 if n else 0):
                a = Counter(grams(words[at : at + n]))
                both = sum(weight(g) * min(c, b[g]) for g, c in a.items())
                if both and both / (sum(weight(g) * c for g, c in a.items()) + sum(weight(g) * c for g, c in b.items()) - both) >= 0.8:
                    found.add((d, i))
    return found


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.choice([12, 20, 45, 80])), 1) for k in range(25)]
    items += [(50, "one two three", 1), (51, None, 1), (52, " . ", 1), (None, text(20), 1), (53, items[0][1], 1)]
    rows = [(i, text(rng.randint(1, 150)), 1) for i in range(60)]
    for k, (_, t, _) in enumerate(items[:25]):
        words = t.split()
        if k % 4 == 1:
            words = [w.upper() + "," for w in words]
        if k % 4 == 2:
            words[len(words) // 2] = "changed"
        if k % 4 == 3:
            words = words[1:] + ["end"]
        rows.append((100 + k, f"{text(rng.randint(0, 40))} {' '.join(words)} {text(rng.randint(0, 40))}", 1))
    rows += [(200, items[3][1], 1), (201, " ".join(items[4][1].split()[1:]), 1), (202, None, 1), (203, "", 1), (204, "x One two, three y", 1), (None, items[5][1], 1)]
    return rows + [rows[60], (205, "a b c d e " * 4000 + items[6][1], 1)], items


def made(items):
    items = [(i, decontam.word_hashes(w)) for i, w in items]
    return decontam.Items(items, decontam.Rarity.count([h for _, h in items]))


def test_near_copies_are_within_the_radius():
    """Pairs at weighted similarity 0.8 and above whose fingerprints the search finds: at least 0.99 of them."""
    rng, pool = random.Random(6), [f"w{i}" for i in range(3000)]
    pick = lambda: pool[min(int(rng.paretovariate(0.7)), 2999)]
    items = [(k, [pick() for _ in range(rng.choice([15, 25, 50, 120, 300]))]) for k in range(300)]
    index, near, found = made(items), 0, 0
    for k, words in items * 12:
        changed = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 40))):
            changed[rng.randrange(len(words))] = pick()
        cut = rng.randint(0, len(words) // 10)
        changed = changed[cut:] + [pick() for _ in range(cut)]
        hashes = decontam.word_hashes(changed)
        if index.similarity(hashes, k) >= 0.8:
            near += 1
            found += k in index.within(index.fingerprints(hashes, np.array([0]), len(hashes)))[1]
    assert near > 800 and found / near >= 0.99, (found, near)


def test_equals_every_window(spark):
    rows, items = corpus()
    got = decontam.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    small = [r for r in rows if r[0] != 205]
    want = plain(small, items) | {(205, 6)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 20
    assert Counter(r["doc_id"] for r in got)[rows[60][0]] in (0, 2, 4)
    assert all(0.8 <= r["similarity"] <= 1 for r in got)
    kept = decontam.clean(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS))
    assert kept.columns == ["doc_id", "text", "N_words"]
    dirty = {d for d, _ in want}
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(d) for d, *_ in rows if d not in dirty)


def test_item_blocks_give_the_same(spark, monkeypatch):
    rows, items = corpus()
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(decontam, "ITEMS", 9)
    assert len(list(decontam.item_blocks(table))) > 2
    got = sorted(map(tuple, decontam.leaks(docs, table).collect()), key=str)
    monkeypatch.undo()
    assert len(list(decontam.item_blocks(table))) == 1
    assert got == sorted(map(tuple, decontam.leaks(docs, table).collect()), key=str) and len(got) > 20
    monkeypatch.setattr(decontam, "ITEM_WORDS", 100)
    assert len(list(decontam.item_blocks(table))) > 3
    assert got == sorted(map(tuple, decontam.leaks(docs, table).collect()), key=str)


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(2)
    index = made([(k, [f"w{rng.randrange(400)}" for _ in range(30)]) for k in range(60)])
    codes = np.array([int(c) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 20))) for c in index.codes.tolist() * 5], np.uint64)
    windows, found = index.within(codes)
    want = {(i, j) for i, c in enumerate(codes.tolist()) for j, d in enumerate(index.codes.tolist()) if (c ^ d).bit_count() <= decontam.RADIUS}
    assert set(zip(windows.tolist(), found.tolist())) == want


def test_no_break_spaces_in_an_item(spark):
    """A verbatim copy of an item is found, whatever white space other than ASCII's lies in it."""
    words = [f"mot{i}" for i in range(50)]
    text = " ".join([*words[:15], "vrai\u00a0:", *words[15:35], "quoi\u00a0?", *words[35:]])
    items = spark.createDataFrame([(1, text, 1)], ITEMS)
    got = decontam.leaks(spark.createDataFrame([(7, f"avant {text} après", 1)], DOCS), items).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in got] == [(7, 1, 1.0)]


def test_one_changed_word_of_fifty_is_a_near_copy():
    """Plain 5-word Jaccard similarity 41/51, among 200 items."""
    items = [(k, [f"w{k}x{i}" for i in range(50)]) for k in range(200)]
    index, words = made(items), list(items[3][1])
    words[25] = "changed"
    hashes = decontam.word_hashes(words)
    assert abs(index.similarity(hashes, 3) - 41 / 51) < 1e-9 and index.similarity(hashes, 4) == 0
    found = index.matches(__import__("pyarrow").array([" ".join(words)]))
    assert [m[0] for m in found[0]] == [3]


def beyond_the_radius():
    """Items, and near copies of them at weighted similarity 0.8 and above whose fingerprints differ in more than RADIUS bits."""
    rng, pool = random.Random(6), [f"w{i}" for i in range(3000)]
    pick = lambda: pool[min(int(rng.paretovariate(0.7)), 2999)]
    items = [(k, [pick() for _ in range(25)]) for k in range(300)]
    index, rows = made(items), []
    for k, words in items * 12:
        changed = list(words)
        changed[rng.randrange(len(words))] = pick()
        changed = changed[1:] + [pick()]
        hashes = decontam.word_hashes(changed)
        if index.similarity(hashes, k) >= 0.8 and (int(index.fingerprints(hashes, np.array([0]), len(hashes))[0]) ^ int(index.codes[k])).bit_count() > decontam.RADIUS:
            rows.append((len(rows), " ".join(changed), k))
    return rows, [(k, " ".join(w), 1) for k, w in items]


def test_near_copies_beyond_the_radius_are_found(spark):
    """No pair at the threshold is lost to the fingerprints, alone, in a longer text, or in the pipeline's stage."""
    rows, items = beyond_the_radius()
    assert len(rows) > 3
    rows += [(1000 + d, f"some other text before {t} and more after", k) for d, t, k in rows]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    got = decontam.leaks(docs, table).collect()
    assert {(d, k) for d, _, k in rows} <= {(r["doc_id"], r["item_id"]) for r in got} == plain(rows, items)
    assert decontam.clean(docs, table).count() == 0


def test_empty_tables(spark):
    rows, items = corpus()
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    assert decontam.leaks(docs.limit(0), table).count() == 0 and decontam.leaks(docs, table.limit(0)).count() == 0
    assert decontam.clean(docs, table.limit(0)).count() == len(rows)


def shared_passages():
    """Items that share passages with each other in threes, and documents with near copies that stand or fall by those shingles' weights."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items, rows = [], []
    for k in range(60):
        if k % 3 == 0:
            passage = text(25)
        items.append((k, " ".join(text(12) + passage + text(12)), 1))
        words = items[-1][1].split()
        words[rng.randrange(2, 8)] = "changed"  # in the item's own words
        rows.append((k, " ".join(text(9) + words + text(9)), 1))
        words = items[-1][1].split()
        words[rng.randrange(16, 33)] = "changed"  # in the shared ones
        rows.append((100 + k, " ".join(text(9) + words + text(9)), 1))
    return rows, [*items, (200, "one two", 1), (201, "one two", 1), (202, "one two", 1), (203, "one two", 1)]


def test_rarity_beyond_the_table_is_exact(spark, monkeypatch):
    """With room for a few of the shingles of several items every similarity is as with room for all."""
    rows, items = shared_passages()
    rows += [(300, "x one two y", 1), (301, "one two", 1), (302, None, 1)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    want = sorted(map(tuple, decontam.leaks(docs, table).collect()))
    assert {x[:2] for x in want} == plain(rows, items) and 60 < len(want) < 140
    for room, words in ((150, 4_000_000), (110, 700)):  # in three parts; in more, over several blocks of items
        monkeypatch.setattr(decontam, "COMMON", room)
        monkeypatch.setattr(decontam, "ITEM_WORDS", words)
        assert sorted(map(tuple, decontam.leaks(docs, table).collect())) == want


def test_clean_beyond_the_table_is_exact(spark, monkeypatch):
    """The pipeline's stage drops the same documents, with all columns, whatever the table has room for."""
    rows, items = shared_passages()
    docs, table = spark.createDataFrame(rows, "doc_id long, text string, Carried int"), spark.createDataFrame(items, ITEMS)
    want = {r[0] for r in rows} - {d for d, _ in plain(rows, items)}
    for room in (2_000_000, 150):
        monkeypatch.setattr(decontam, "COMMON", room)
        kept = decontam.clean(docs, table)
        assert kept.columns == ["doc_id", "text", "Carried"] and {r["doc_id"] for r in kept.collect()} == want
